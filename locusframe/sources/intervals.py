"""Text formats of intervals: BED, bedGraph, GFF/GTF, VCF, chrom.sizes; and region sources of any kind.

Every reader gives ``ord``, which grows in file order, before anything can shuffle the rows.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INTERVALS

_BED = "chrom string, start long, end long, name string, score string, strand string"
_GFF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
_VCF = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string"


def _lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="PERMISSIVE", quote="")
    rows = rows.where(F.col("chrom").isNotNull() & ~F.col("chrom").rlike("^(track|browser)( |$)"))
    return rows.withColumns({"ord": F.monotonically_increasing_id(), "file": F.input_file_name()})


def check_files(files: str | list[str]) -> list[str]:
    listed = [files] if isinstance(files, str) else list(files or [])
    if not listed:
        raise ValueError("no files given")
    return listed


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """BED of three to six columns; a missing strand is '.'."""
    out = _lines(spark, check_files(path), _BED)
    return out.select("chrom", "start", "end", "name", "score", F.coalesce("strand", F.lit(".")).alias("strand"), "ord", "file")


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The last column is the score."""
    out = _lines(spark, check_files(path), _BED)
    score = F.coalesce("strand", "score", "name")
    return out.select("chrom", "start", "end", F.lit(None).cast("string").alias("name"), score.alias("score"), F.lit(".").alias("strand"), "ord", "file")


def read_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GFF and GTF: starts are 1-based and inclusive in the file."""
    out = _lines(spark, check_files(path), _GFF)
    return out.select("chrom", (F.col("start") - 1).alias("start"), "end", F.col("feature").alias("name"), "score", F.coalesce("strand", F.lit(".")).alias("strand"), "ord", "file", "attributes")


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variants (name, chrom, pos (1-based), ref, alt, ord) with their region of the reference (start, end).

    An alternative that is missing in the file is an empty string; several are one string with commas.
    """
    out = _lines(spark, check_files(path), _VCF)
    blank = lambda c: F.when(F.col(c) == ".", "").otherwise(F.coalesce(F.col(c), F.lit("")))
    return out.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"), blank("id").alias("name"), F.col("qual").alias("score"), F.lit(".").alias("strand"), "ord", "file", "pos", F.upper("ref").alias("ref"), F.upper(blank("alt")).alias("alt"))


def read_chrom_sizes(spark: SparkSession, path: str, skip_random: bool = True) -> DataFrame:
    """(chrom, length, ord); names with an underscore are left out unless told otherwise."""
    out = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, length long").withColumn("ord", F.monotonically_increasing_id())
    return out.where(~F.contains("chrom", F.lit("_"))) if skip_random else out


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a file of any of the formats, by its name."""
    name = PurePosixPath(path).name.removesuffix(".gz").lower()
    if name.endswith((".gtf", ".gff", ".gff3")):
        return read_gff(spark, path)
    if name.endswith(".vcf"):
        return read_vcf(spark, path)
    return read_bedgraph(spark, path) if name.endswith((".bedgraph", ".bdg")) else read_bed(spark, path)


def as_intervals(spark: SparkSession, source) -> DataFrame:
    """Intervals from a path, a DataFrame, a pandas DataFrame, or tuples (chrom, start, end[, name, score, strand])."""
    if isinstance(source, str):
        return read_regions(spark, source)
    if isinstance(source, DataFrame):
        df = source
    elif hasattr(source, "to_dict") and hasattr(source, "columns"):
        missing = [c for c in ("chrom", "start", "end") if c not in source.columns]
        if missing:
            raise ValueError(f"regions lack {', '.join(missing)}")
        df = spark.createDataFrame(source.assign(ord=range(len(source))))
    else:
        rows = [(*r, *[None] * (6 - len(r)), i) for i, r in enumerate(tuple(x) for x in source)]
        df = spark.createDataFrame(rows, INTERVALS)
    missing = [c for c in ("chrom", "start", "end") if c not in df.columns]
    if missing:
        raise ValueError(f"regions lack {', '.join(missing)}")
    cols = {c: F.col(c).cast("long") for c in ("start", "end")}
    cols["strand"] = F.coalesce(F.col("strand"), F.lit(".")) if "strand" in df.columns else F.lit(".")
    for c in ("name", "score"):
        cols[c] = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    if "ord" not in df.columns:
        cols["ord"] = F.monotonically_increasing_id()
    return df.withColumns(cols)


def stem(path: str) -> str:
    """A condition's name from a file's."""
    return PurePosixPath(path).name.rsplit(".", 1)[0]
