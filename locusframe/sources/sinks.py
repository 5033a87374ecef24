"""Sinks: scores as JSON and TSV, predictions and tracks as BED, bedGraph and BIGWIG, cached tables as Parquet."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import track
from ..schema import floor_div
from ..shipping import ship


def score_json(scores: DataFrame, keys: list[str] = ("model", "layer", "condition")) -> DataFrame:
    """(key, json): a score a row; the key joins its parts with '-'."""
    key = F.concat_ws("-", *keys)
    return scores.select(key.alias("key"), F.to_json(F.struct(key.alias("key"), F.col("value"))).alias("json"))


def write_json(scores: DataFrame, path: str) -> None:
    score_json(scores).select("json").write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


class ExportJson:
    """Scores as lines of {key, value}; ``annot`` and ``row_names`` are lines of their own."""

    def __init__(self, filesuffix: str = "json", annot: dict | None = None, row_names: list | None = None):
        self.suffix, self.more = filesuffix, {k: v for k, v in (("annot", annot), ("row_names", row_names)) if v is not None}

    def rows(self, results: DataFrame, keys: list[str]) -> DataFrame:
        values = [c for c in results.columns if c not in ("model", "layer", "condition")]
        value = F.col("value") if values == ["value"] else F.struct(*values)
        out = results.select(F.to_json(F.struct(F.concat_ws("-", *keys).alias("key"), value.alias("value"))).alias("json"))
        lines = [(json.dumps({"key": k, "value": v}),) for k, v in self.more.items()]
        return out.unionByName(results.sparkSession.createDataFrame(lines, "json string")) if lines else out

    def __call__(self, folder: str, name: str, results: DataFrame, keys: list[str]) -> None:
        self.rows(results, keys).write.mode("overwrite").text(f"{folder}/{name}.{self.suffix}")


class ExportTsv:
    """Scores as a column a key and a row a place (one place where there is no ``idx``), then annotations and row names."""

    def __init__(self, filesuffix: str = "tsv", annot: dict | None = None, row_names: list | None = None):
        self.suffix, self.more = filesuffix, {f"annot.{k}": v for k, v in (annot or {}).items()} | ({} if row_names is None else {"row_names": row_names})

    def rows(self, results: DataFrame, keys: list[str]) -> DataFrame:
        at = [c for c in ("idx", "bin") if c in results.columns] or ["idx"]
        if "idx" not in results.columns:
            results = results.withColumn("idx", F.lit(0).cast("long"))
        named = results.withColumn("_key", F.concat_ws("-", *keys))
        names = sorted(r[0] for r in named.select("_key").distinct().collect())  # they become columns
        out = named.groupBy(*at).pivot("_key", names).agg(F.first("value"))
        if self.more:
            lists = [[x.item() if hasattr(x, "item") else x for x in v] for v in self.more.values()]
            held = results.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(zip(*lists, strict=True))], ["idx", *(f"_m{i}" for i in range(len(lists)))])
            out = out.join(held, "idx", "left").withColumnsRenamed({f"_m{i}": k for i, k in enumerate(self.more)})
        return out

    def __call__(self, folder: str, name: str, results: DataFrame, keys: list[str]) -> None:
        rows = self.rows(results, keys)
        at = [c for c in ("idx", "bin") if c in rows.columns]
        rows = rows.repartitionByRange(*at).sortWithinPartitions(*at)
        write_tsv(rows.drop(*at), f"{folder}/{name}.{self.suffix}")


class ExportBed:
    """Predictions (idx, bin, condition, value) of windows as BED, a folder a key."""

    def __init__(self, windows: DataFrame, resolution: int):
        self.windows, self.resolution = windows, resolution

    def __call__(self, folder: str, name: str, results: DataFrame, keys: list[str]) -> None:
        named = results.select("idx", "bin", F.concat_ws(".", *keys).alias("condition"), "value")
        write_bed(bed_rows(self.windows, named, self.resolution), f"{folder}/{name}.bed")


class ExportBigwig(ExportBed):
    """Predictions of windows as BIGWIG, a file a key; of windows that overlap, the last one is written."""

    def track(self, results: DataFrame, keys: list[str]) -> DataFrame:
        named = results.select("idx", "bin", F.concat_ws(".", *keys).alias("condition"), "value")
        w = self.windows.select("idx", "chrom", F.col("start").alias("_w"), F.col("end").alias("_e")).join(named, "idx")
        start = F.col("_w") + F.col("bin") * self.resolution
        runs = w.select("chrom", start.alias("start"), F.least(start + self.resolution, F.col("_e")).alias("end"), F.lit(0).alias("strand"), "condition", "value", F.col("idx").cast("long").alias("ord")).where("start < end")
        return track.paint(runs, ["value"], ["strand", "condition"])

    def __call__(self, folder: str, name: str, results: DataFrame, keys: list[str]) -> None:
        sizes = self.windows.groupBy("chrom").agg(F.max("end").alias("length"))
        write_bigwigs(self.track(results, keys), sizes, folder, name)


def bed_rows(windows: DataFrame, predictions: DataFrame, resolution: int) -> DataFrame:
    """(chrom, start, end, name, score, condition): each window in pieces of ``resolution``, with its (idx, bin, condition, value)."""
    rows = windows.select("idx", "chrom", F.col("start").alias("_w"), F.col("end").alias("_e")).join(predictions, "idx")
    n = floor_div(F.col("_e") - F.col("_w"), resolution)
    start = F.col("_w") + F.col("bin") * resolution
    return rows.where(F.col("bin") < n).select("chrom", start.alias("start"), (start + resolution).alias("end"), F.lit(".").alias("name"), F.col("value").alias("score"), "condition")


def write_bed(rows: DataFrame, path: str, by: str | None = "condition") -> None:
    out = rows.write.mode("overwrite")
    (out.partitionBy(by) if by else out).csv(path, sep="\t")


def bedgraph_rows(track: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """(condition, chrom, start, end, value) summed over strands, where not 0. Runs of one strand don't overlap.

    Runs are cut at multiples of ``bin_size`` and where the other strand's begin or end: a sort sees one bin's borders.
    """
    at = F.explode(F.sequence(floor_div(F.col("start"), bin_size), floor_div(F.col("end") - 1, bin_size))).alias("_bin")
    cut = track.where("end > start").select("condition", "chrom", "strand", "start", "end", "value", at)
    cut = cut.withColumns({"start": F.greatest(F.col("start"), F.col("_bin") * bin_size), "end": F.least(F.col("end"), (F.col("_bin") + 1) * bin_size)})
    cell = ["condition", "chrom", "_bin"]
    # what each strand is from each border on: the value of what begins there, else 0 where something ends
    border = lambda at, begins: F.struct(F.col(at).alias("s"), F.col("strand").alias("strand"), F.when(F.lit(begins), F.col("value")).alias("v"))
    steps = cut.select(*cell, F.explode(F.array(border("start", True), border("end", False))).alias("x"))
    state = lambda k: F.coalesce(F.max(F.when(F.col("x.strand") == k, F.col("x.v"))), F.max(F.when(F.col("x.strand") == k, F.lit(0.0)))).alias(f"v{k}")
    steps = steps.groupBy(*cell, F.col("x.s").alias("start")).agg(state(0), state(1))
    w = Window.partitionBy(*cell).orderBy("start")
    now = lambda k: F.coalesce(F.last(f"v{k}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    out = steps.select("condition", "chrom", "start", F.lead("start").over(w).alias("end"), (now(0) + now(1)).alias("value"))
    return out.where("end is not null and value <> 0")


def write_bedgraph(track: DataFrame, path: str) -> None:
    """A folder a condition, sorted by chromosome and start."""
    rows = bedgraph_rows(track).repartitionByRange("condition", "chrom", "start").sortWithinPartitions("condition", "chrom", "start")
    rows.write.mode("overwrite").partitionBy("condition").csv(path, sep="\t")


def write_bigwigs(track: DataFrame, sizes: DataFrame, folder: str, name: str) -> None:
    """``folder``/name.condition.bigwig on a mounted file system. The format is one sequential file, so each is one task."""
    ship(track.sparkSession)
    rows = bedgraph_rows(track)
    lengths = [(r.chrom, r.length) for r in sizes.select("chrom", "length").collect()]  # a row a chromosome
    os.makedirs(folder, exist_ok=True)
    for (condition,) in track.select("condition").distinct().collect():
        path = f"{folder}/{name}.{condition}.bigwig"

        def run(batches, path=path):
            import pandas as pd

            from .bigwig import write_bigwig

            with open(path, "wb") as f:
                write_bigwig(f, lengths, (tuple(r) for pdf in batches for r in pdf.itertuples(index=False)))
            yield pd.DataFrame({"path": [path]})

        one = rows.where(F.col("condition") == condition).select("chrom", "start", "end", "value")
        one.repartition(1).sortWithinPartitions("chrom", "start").mapInPandas(run, "path string").collect()


def cache_key(parts: dict, files: list = ()) -> str:
    """SHA-256 of parameters and of each file's name, size and time (``ranged.stamps``), or of what else stands for it."""
    return hashlib.sha256(json.dumps([parts, list(files)], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table of a key in a folder, made and written if it isn't there."""
    path = f"{folder}/{key}"
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def output_folder() -> str:
    """Where results go unless told otherwise."""
    return os.environ.get("LOCUSFRAME_OUTPUT", os.path.join(os.path.expanduser("~"), "locusframe_results"))


def label(*parts: str) -> Column:
    return F.concat_ws("-", *map(F.lit, parts))
