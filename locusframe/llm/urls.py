"""URL filters: allow and block rules over host suffixes and path prefixes.

Each distinct URL is expanded into its host-suffix and path-prefix expressions, of the shapes (labels, path
length) that occur among the rules: one literal of the plan, of at most as many entries as hosts' labels times paths'
lengths occur together, whatever the number of rules. Expressions and rules meet in an equality join on a short prefix
of their SHA-256 digests; the full digests confirm. Of several confirmed rules the longest (host and path) decides; of
equally long ones a block before an allow, then the one of the longer host, then the lesser text.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; rows that repeat a
page_id are judged each; no rules or no pages give the default verdict or no rows; rules with a null part are
ignored. Hosts compare in lower case, paths as they are. Columns of the input named host, path, rule or verdict are
replaced, others are carried whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest in the equality join: 4 bytes.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a rule list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    marked = pages.select(F.struct(F.lit(0), *others).alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    given = rules.dropna().select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    shapes = sorted(tuple(r) for r in given.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect())
    parts = F.concat_ws("\x00", "host", "path", F.length("host"))
    digest = given.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_n"), F.sha2(parts, 256).alias("digest")).distinct()
    digest = digest.withColumn("short", F.substring("digest", 1, SHORT))

    urls = marked.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    wanted = F.from_json(F.lit(json.dumps([{"l": a, "n": b} for a, b in shapes])), "array<struct<l:int,n:int>>")
    fits = F.filter(wanted, lambda s: (F.col("host") != "") & (F.size("labels") >= s["l"]) & (F.length("path") >= s["n"]))

    def expression(s: Column) -> Column:
        return F.struct(F.array_join(F.slice("labels", -s["l"], s["l"]), ".").alias("h"), F.substring("path", F.lit(1), s["n"]).alias("p"))

    asked = urls.select("host", "path", F.explode(F.transform(fits, expression)).alias("e"))
    asked = asked.select("host", "path", F.sha2(F.concat_ws("\x00", "e.h", "e.p", F.length("e.h")), 256).alias("full"))
    met = asked.withColumn("short", F.substring("full", 1, SHORT)).join(digest, "short").where("full = digest")
    # the greatest of: length, block, host's length, then the least text
    ranked = F.struct(-F.length("rule"), F.col("verdict") != "block", -F.col("host_n"), "rule", "verdict")
    found = met.groupBy("host", "path").agg(F.min(ranked).alias("found"))
    out = marked.join(found, ["host", "path"], "left")
    return out.select(*(F.col("row")[c].alias(c) for c in others), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
