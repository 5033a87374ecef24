"""FASTA files as (chrom, seq, ord): the id up to the first white space, and all its lines joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import alphabet, pad


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records are split at '>' by the reader, so a file of many records is read by many tasks."""
    rows = spark.read.text(path, lineSep=">").where(F.btrim("value") != "").withColumn("ord", F.monotonically_increasing_id())
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 1, F.length("value"))
    name = F.regexp_extract(head, r"^\s*(\S+)", 1)
    return rows.select(name.alias("chrom"), F.regexp_replace(body, r"\s+", "").alias("seq"), "ord")


def fixed_length(sequences: DataFrame, fixedlen: int | None = None, seqtype: str = "dna") -> DataFrame:
    """Sequences as regions: ids must be unique and, once cut or filled to ``fixedlen``, lengths equal."""
    alphabet(seqtype)
    out = sequences.withColumn("seq", pad(F.col("seq"), fixedlen)) if fixedlen else sequences
    n, ids, lengths = out.agg(F.count("*"), F.count_distinct("chrom"), F.count_distinct(F.length("seq"))).first()
    if n != ids:
        raise ValueError("sequence ids must be unique")
    if lengths > 1:
        raise ValueError("sequences must be of one length: give fixedlen")
    return out


def sizes(sequences: DataFrame) -> DataFrame:
    return sequences.select("chrom", F.length("seq").cast("long").alias("length"), "ord")
