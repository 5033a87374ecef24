"""Interval joins as equality joins on (chrom, bin).

Chromosomes are few and uneven, so a join on them alone has a handful of huge partitions. Both sides are laid on a
grid of bins; an overlapping pair is found in each bin that both touch and is kept only in the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import floor_div, running_total


def suggest_bin(*sides: DataFrame) -> int:
    """A power of two about as long as the longer side's mean interval."""
    means = [s.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1 for s in sides]
    return 1 << max(4, int(max(means)).bit_length())


def binned(df: DataFrame, bin_size: int, start: str = "start", end: str = "end", into: str = "_bin") -> DataFrame:
    """A row for each bin that an interval touches; empty intervals touch none."""
    first, last = floor_div(F.col(start), bin_size), floor_div(F.col(end) - 1, bin_size)
    return df.where(F.col(end) > F.col(start)).withColumn(into, F.explode(F.sequence(first, last)))


def _renamed(df: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    return df.select([F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int | None = None, prefix: str = "r_", clustered: bool = False) -> DataFrame:
    """Inner join of overlapping intervals; the right side's columns get ``prefix``.

    ``clustered``: both sides meet in the order of their starts within bins, so that pairs, of which dense inputs make
    many a row, come out alike one after the other and take little room where they are written.
    """
    size = bin_size or suggest_bin(left, right)
    a = binned(left, size)
    b = _renamed(binned(right, size), prefix, ["_bin"])
    if clustered:
        # Catalyst takes sorts out from under a join, but not from under a filter of an unknown outcome (it is always true)
        held = lambda df, p: df.repartition(f"{p}chrom", "_bin").sortWithinPartitions(f"{p}chrom", "_bin", f"{p}start", f"{p}end").where(F.monotonically_increasing_id() >= 0)
        a, b = held(a, ""), held(b, prefix).hint("merge")
    met = a.join(b, (F.col("chrom") == F.col(f"{prefix}chrom")) & (a["_bin"] == b["_bin"]) & (F.col("start") < F.col(f"{prefix}end")) & (F.col(f"{prefix}start") < F.col("end")))
    # both touch the bin, so it is their first common one unless both starts lie before it
    return met.where(F.greatest(F.col("start"), F.col(f"{prefix}start")) >= a["_bin"] * size).drop("_bin")


def overlap_semi(left: DataFrame, right: DataFrame, key: str, bin_size: int | None = None, anti: bool = False) -> DataFrame:
    """The rows of ``left`` (``key`` names each) that overlap some row of ``right``, or none with ``anti``."""
    return left.join(_hits(left, right, key, bin_size), key, "left_anti" if anti else "left_semi")


def _hits(left: DataFrame, right: DataFrame, key: str, bin_size: int | None) -> DataFrame:
    """The keys of rows of ``left`` that overlap some row of ``right``."""
    size = bin_size or suggest_bin(left, right)
    a = binned(left.select(key, "chrom", "start", "end"), size)
    b = _renamed(binned(right.select("chrom", "start", "end").distinct(), size), "r_")
    met = a.join(b, (F.col("chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("r__bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")), "left_semi")
    return met.select(key).distinct()


def overlap_left(left: DataFrame, right: DataFrame, key: str, bin_size: int | None = None, prefix: str = "r_") -> DataFrame:
    """Left outer join of overlapping intervals: pairs stay where they met, and rows that met none follow."""
    size = bin_size or suggest_bin(left, right)
    none = [F.lit(None).cast(f.dataType).alias(prefix + f.name) for f in right.schema]
    return overlap_join(left, right, size, prefix).unionByName(overlap_semi(left, right, key, size, anti=True).select("*", *none))


def overlap_counts(left: DataFrame, right: DataFrame, key: str, bin_size: int = 1 << 14) -> DataFrame:
    """(key, n, bases) for each row of ``left``: how many rows of ``right`` overlap it, and the bases they share with it.

    No pair is made. With S and E the starts and ends of ``right`` up to a position p, and W the sum of those starts
    less that of those ends, p * (S - E) - W bases lie before p: two look-ups a row, in running totals within bins and over
    a list with a row a bin.
    """
    none = F.lit(0).cast("long")
    row = lambda p, side, s=none, e=none, way=none: F.struct(p.alias("_p"), F.lit(side).alias("_side"), s.alias("_s"), e.alias("_e"), way.alias("_way"))
    start, end, one = F.col("start").cast("long"), F.col("end").cast("long"), F.lit(1).cast("long")
    # at one position ends of ``left`` see what is before it, starts of ``left`` what is up to it
    marks = right.where("chrom is not null and start < end").select("chrom", F.explode(F.array(row(start, 1, one), row(end, 1, none, one))).alias("_x"))
    marks = marks.groupBy("chrom", F.col("_x._p").alias("_p")).agg(F.sum("_x._s").alias("_s"), F.sum("_x._e").alias("_e"))
    marks = marks.select("chrom", F.lit(None).cast(left.schema[key].dataType).alias(key), "_p", F.lit(1).alias("_side"), "_s", "_e", none.alias("_way"))
    way = F.when(F.col("start") < F.col("end"), one).otherwise(none)
    asked = left.select("chrom", key, F.explode(F.array(row(end, 0, way=way), row(start, 2, way=-way))).alias("_x")).select("chrom", key, "_x.*")
    rows = marks.unionByName(asked).withColumn("_bin", floor_div(F.col("_p"), bin_size)).withColumn("_w", F.col("_p") * (F.col("_s") - F.col("_e")))
    totals = ["_s", "_e", "_w"]
    bins = rows.groupBy("chrom", "_bin").agg(*(F.sum(c).alias(c) for c in totals))
    earlier = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    bins = bins.select("chrom", "_bin", *(F.coalesce(F.sum(c).over(earlier), none).alias(f"_before{c}") for c in totals))
    here = Window.partitionBy("chrom", "_bin").orderBy("_p", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("chrom", "_bin", key, "_p", "_side", "_way", *(F.sum(c).over(here).alias(c) for c in totals)).where("_side <> 1").join(bins, ["chrom", "_bin"], "left")
    s, e, w = (F.col(c) + F.coalesce(f"_before{c}", none) for c in totals)
    n = F.col("_way") * F.when(F.col("_side") == 0, s).otherwise(e)
    bases = F.col("_way") * (F.col("_p") * (s - e) - w)
    return seen.select(key, n.alias("_n"), bases.alias("_b")).groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_b").alias("bases"))


def annotate_strand(left: DataFrame, right: DataFrame, key: str, bin_size: int | None = None, places: DataFrame | None = None) -> DataFrame:
    """Adds ``annotated``: '-' where any overlapping row of ``right`` is on the minus strand, else '+'.

    ``places``: (key, chrom, start, end) of the left rows, where that takes less than making these rows twice.
    """
    minus = _hits(left if places is None else places, right.where(F.col("strand") == "-"), key, bin_size).withColumn("_minus", F.lit(True))
    return left.join(minus, key, "left").withColumn("annotated", F.when(F.col("_minus"), "-").otherwise("+")).drop("_minus")


def merge_intervals(df: DataFrame, distance: int = 0, bin_size: int = 1 << 20) -> DataFrame:
    """(chrom, start, end): the union of intervals that overlap or lie within ``distance`` of each other.

    Islands are made within bins of starts. An island begins a result unless an earlier bin reaches it, for which the
    greatest end of each bin is enough: no pass sees a whole chromosome's rows.
    """
    rows = df.select("chrom", "start", "end").withColumn("_bin", floor_div(F.col("start"), bin_size))
    w = Window.partitionBy("chrom", "_bin").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("start") <= reach + distance, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy("chrom", "_bin", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    earlier = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    bins = islands.groupBy("chrom", "_bin").agg(F.max("end").alias("_top"))
    bins = bins.select("chrom", "_bin", F.max("_top").over(earlier).alias("_reach"))
    begun = islands.join(bins, ["chrom", "_bin"]).withColumn("_begins", F.when(F.col("start") <= F.col("_reach") + distance, 0).otherwise(1))
    numbered = running_total(begun.select("chrom", "start", "end", "_begins"), ["chrom"], "start", "_begins", "_earlier", bin_size)
    return numbered.groupBy("chrom", (F.col("_earlier") + F.col("_begins")).alias("_n")).agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end")


def nearest_before(left: DataFrame, right: DataFrame, key: str, value: Column, bin_size: int = 1 << 16) -> DataFrame:
    """As-of join: for each row of ``left``, ``value`` of the last row of ``right`` that starts at or before it.

    Rows meet within bins; the last row of earlier bins comes from a list with a row a bin. Of rows of ``right`` with
    equal starts the one of the greatest value counts.
    """
    rows = left.select("chrom", "start", F.col(key).alias("_key"), F.lit(None).cast("struct<v:string>").alias("_value"), F.lit(1).alias("_side"))
    held = F.struct(value.cast("string").alias("v"))
    rows = rows.unionByName(right.select("chrom", "start", F.lit(None).cast(left.schema[key].dataType).alias("_key"), held.alias("_value"), F.lit(0).alias("_side")))
    rows = rows.withColumn("_bin", floor_div(F.col("start"), bin_size))
    w = Window.partitionBy("chrom", "_bin").orderBy("start", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    bins = rows.groupBy("chrom", "_bin").agg(F.max(F.when(F.col("_side") == 0, F.struct("start", "_value"))).alias("_top"))
    bins = bins.select("chrom", "_bin", F.last("_top", ignorenulls=True).over(earlier).alias("_top"))
    found = rows.withColumn("_here", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").join(bins, ["chrom", "_bin"])
    found = found.select(F.col("_key").alias(key), F.coalesce("_here", "_top._value")["v"].alias("value"))
    return left.join(found, key, "left")
