"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import decontam, lines, packing, rules, simhash
from locusframe.llm.common import shared_folder, table


def _sized(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of ``before``, with n_chars, where there is one, of the texts as they are now."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return docs.select(before.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the heuristics, without their host's frequent lines; n_chars follows the text.

    Null and blank texts fail, rows that repeat are judged each and alike, an empty table gives no rows, extra columns
    are kept as they are.
    """
    return _sized(rules.cleaned(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks that an earlier one has, where words are left; n_chars follows the text.

    Of equal texts the one with the least id stays, a null id before all; rows equal in id and text stay or go together; null texts stay, blank
    ones too unless something was taken; an empty table gives no rows, extra columns are kept as they are.
    """
    out = lines.deduplicate(docs, mean_lines=2, removed_col="lines lost")
    return _sized(out.where((F.col("lines lost") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: of all pairs whose five-word shingles have a Jaccard similarity of 0.8 or
    more. 128-bit SimHash fingerprints propose links, a prefix filter on shingles finds the rest.

    The least id of a class stays, then the least MD5 of its text; of rows equal in both one, null ids where no row of
    the class has one. Null and blank texts are one class; an empty table gives no rows, extra columns are kept.
    """
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 13-word window of the benchmark (or a whole shorter item), however long they are.

    Null and blank texts stay, rows that repeat stay or go together; an empty table gives no rows, an empty benchmark
    takes none; extra columns are kept.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), share=None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 2048 tokens.

    Null and blank texts are their closing id (and white space); rows that repeat are packed each; an empty table gives
    no rows; extra columns are not read.
    """
    return packing.pack(packing.pieces(docs, capacity=2048), capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Near-dedup and packing are sequential choices: tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one's is the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
