"""Normalisers: functions from track to track.

Positions without a run are 0 until a normaliser moves them; a ``Signal`` carries what they have become for each
condition, so that tracks stay sparse.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .track import cell_count, moments


@dataclass(frozen=True)
class Signal:
    """A track; ``cells``: one row with the number of its cells; ``zero``: (condition, background)."""

    runs: DataFrame
    cells: DataFrame
    zero: DataFrame

    @classmethod
    def of(cls, runs: DataFrame, sizes: DataFrame, resolution: int = 1, strands: int = 1) -> Signal:
        return cls(runs, cell_count(sizes, resolution, strands), runs.select("condition").distinct().withColumn("background", F.lit(0.0)))

    def map(self, f: Callable[[Column], Column], stats: DataFrame | None = None) -> Signal:
        """``f`` of each value, which may use the columns of ``stats`` (condition, ...)."""

        def done(df: DataFrame, column: str) -> DataFrame:
            joined = df.join(F.broadcast(stats), "condition") if stats is not None else df  # a row a condition
            return joined.withColumn(column, f(F.col(column))).select(df.columns)

        return replace(self, runs=done(self.runs, "value"), zero=done(self.zero, "background"))


def log_transform(x: Signal) -> Signal:
    return x.map(lambda v: F.log1p(v))


@dataclass
class ZScore:
    """Centre and scale; statistics are fitted on the first signal unless given as (condition, mean, sd), and kept.

    A condition of constant values, whose sd is 0, is centred only, and so becomes 0.
    """

    stats: DataFrame | None = None

    def __call__(self, x: Signal) -> Signal:
        if self.stats is None:
            self.stats = _moments(x)
        return x.map(lambda v: (v - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)), self.stats)


def _moments(x: Signal) -> DataFrame:
    """Moments over all cells, of a signal whose background may have moved."""
    shifted = x.runs.join(F.broadcast(x.zero), "condition").withColumn("value", F.col("value") - F.col("background")).drop("background")
    return moments(shifted, x.cells).join(F.broadcast(x.zero), "condition").select("condition", (F.col("mean") + F.col("background")).alias("mean"), "sd")


@dataclass
class ZScoreLog(ZScore):
    def __call__(self, x: Signal) -> Signal:
        return super().__call__(log_transform(x))


def region_length(x: Signal, length: int | Column) -> Signal:
    """Values over the length of their window, or the resolution of a whole genome."""
    length = F.lit(length) if isinstance(length, int) else length
    return x.map(lambda v: v / length)


def tpm(x: Signal, length: int) -> Signal:
    """Transcripts per million: values per kilobase, scaled so that those of a condition sum to a million."""
    per_kb = region_length(x, length).map(lambda v: v * 1000)
    n = F.col("end") - F.col("start")
    sums = per_kb.runs.groupBy("condition").agg((F.sum(F.col("value") * n) / 1e6).alias("per_million"))
    return per_kb.map(lambda v: v / F.col("per_million"), sums)


def percentile_trim(x: Signal, percentile: float = 99.0) -> Signal:
    """Values above the percentile (linear interpolation, over all cells) become it."""
    n = (F.col("end") - F.col("start")).cast("long")
    counts = x.runs.select("condition", "value", n.alias("n"))
    held = counts.groupBy("condition").agg(F.sum("n").alias("_n"))
    rest = x.zero.join(F.broadcast(held), "condition").crossJoin(F.broadcast(x.cells)).select("condition", F.col("background").alias("value"), (F.col("cells") - F.col("_n")).alias("n"))
    limits = counts.unionByName(rest.where("n > 0")).groupBy("condition").agg(F.percentile("value", percentile / 100, F.col("n")).alias("limit"))
    return x.map(lambda v: F.least(v, F.col("limit")), limits)


def shift(x: Signal, means: DataFrame) -> Signal:
    return x.map(lambda v: v - F.col("mean"), means)


def rescale(x: Signal, scales: DataFrame) -> Signal:
    return x.map(lambda v: v / F.col("scale"), scales)


def normalizer(name: str | Callable[[Signal], Signal], length: int = 1) -> Callable[[Signal], Signal]:
    """A normaliser by name, or the caller's own."""
    if callable(name):
        return name
    known = {"zscore": ZScore(), "zscorelog": ZScoreLog(), "binsizenorm": lambda x: region_length(x, length), "perctrim": percentile_trim, "tpm": lambda x: tpm(x, length)}
    if name not in known:
        raise ValueError(f"unknown normalizer {name}")
    return known[name]


def normalize(x: Signal, names: list[str | Callable], length: int = 1) -> Signal:
    """Normalisers in the given order."""
    for n in names:
        x = normalizer(n, length)(x)
    return x
