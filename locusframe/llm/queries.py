"""The queries of the corpus operators, by name; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    cut = pieces(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)
    return pack(cut, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: The rules that the pages are judged by: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge, rules_table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judged

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lm import scores

    found = scores(table(spark, sf_dir, "documents"), order=3, backoff=0.4, min_count=2)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import digests, repeats

    return digests(repeats(table(spark, sf_dir, "documents"), window=13, block=7))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality_model import score, train

    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    weights = train(docs, labels, bits=18, order=2, most_rows=20_000, epochs=3)
    found = score(docs, weights, order=2)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontam import report

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = report(docs, table(spark, sf_dir, "benchmark"), window=13, k=5, share=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import summary

    return summary(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lines import deduplicate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = deduplicate(docs, removed_col="n_removed_lines")
    return found.select("doc_id", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
