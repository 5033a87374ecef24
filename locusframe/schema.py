"""Schemas and coordinates: 0-based, half-open intervals; ``ord`` is file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVALS = "chrom string, start long, end long, name string, score string, strand string, ord long"
#: Signal as runs: strand axis 0 (plus, or unstranded) or 1 (minus).
RUNS = "chrom string, start long, end long, strand int, condition string, value double"
STRANDS = ("+", "-", ".")


def floor_div(a: Column, b: Column | int) -> Column:
    """Division that rounds down, as bins and tiles need; Spark's ``div`` truncates."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def ceil_div(a: Column, b: Column | int) -> Column:
    return -floor_div(-a, b)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlapping positions; 0 or less for none."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def strand_axis(strand: Column) -> Column:
    return F.when(strand == "-", 1).otherwise(0)


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where its scan has fewer partitions than there are cores, as of a file with few row groups.

    So much is read only where the input is small for the cluster; a larger one is read as it lies, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def running_total(df: DataFrame, by: list[str], order: str, value: str, into: str, block: int = 1 << 16) -> DataFrame:
    """Adds the exclusive running total of ``value`` in the order of a long column.

    Two levels, so that no task sorts everything: totals inside blocks of order values, and a short list of block
    totals.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_block", floor_div(F.col(order), block))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(*by, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    out = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(base, [*by, "_block"]).withColumn(into, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")
