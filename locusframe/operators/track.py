"""Tracks: genome-wide signal as runs, and their reading per window.

Runs of one (strand, condition) don't overlap and positions without a run hold the background, 0. Raw features
become runs first (counts per position, painted segments), so that the range join with windows sees each position
once however deep the coverage is.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..schema import ceil_div, floor_div
from ..shipping import ship
from .rangejoin import overlap_join, overlap_semi, suggest_bin

COLLAPSERS = ("sum", "mean", "max")


# -- aligned reads

READ_COLUMNS = ("chrom", "reference_start", "reference_end", "is_reverse", "is_unmapped", "mapq", "is_paired", "is_proper_pair", "is_read2", "next_chrom", "next_reference_start", "template_length", "query_length")


def usable_reads(reads: DataFrame, min_mapq: int | None = None) -> DataFrame:
    """Mapped reads of enough quality; paired ones only if properly paired on one chromosome."""
    kept = reads.where(~F.col("is_unmapped") & (F.col("mapq") >= (min_mapq or 0)))
    return kept.where(~F.col("is_paired") | (F.col("is_proper_pair") & (F.col("next_chrom") == F.col("chrom"))))


def read_position(pairedend: str = "5prime") -> Column:
    """Where a read counts; null where it doesn't.

    'midpoint': the middle of a pair, of its first read only. Otherwise the outer end of the read or pair: a reverse read's
    end, a forward read's start.
    """
    single = F.when(F.col("is_reverse"), F.col("reference_end")).otherwise(F.col("reference_start"))
    lower = F.least("reference_start", "next_reference_start")
    if pairedend == "midpoint":
        paired = F.when(~F.col("is_read2"), lower + floor_div(F.abs("template_length"), 2))
    else:
        paired = F.when(F.col("is_reverse"), F.greatest(F.col("reference_end"), F.col("next_reference_start") + F.col("query_length"))).otherwise(lower)
    return F.when(F.col("is_paired"), paired).otherwise(single)


def read_track(reads: DataFrame, condition: Column | str = "reads", min_mapq: int | None = None, pairedend: str = "5prime", stranded: bool = True, sizes: DataFrame | None = None, flank: int = 0) -> DataFrame:
    """Runs of one position with the number of reads there."""
    condition = F.lit(condition) if isinstance(condition, str) else condition
    strand = F.col("is_reverse").cast("int") if stranded else F.lit(0)
    # exploded, or filters of the place would be put to work on the reads, with a copy of all that makes it for each mention
    place = F.explode(F.array(read_position(pairedend))).alias("start")
    rows = usable_reads(reads, min_mapq).select("chrom", place, strand.alias("strand"), condition.alias("condition")).where("start is not null")
    if sizes is not None:
        rows = rows.join(sizes.select("chrom", "length"), "chrom").where((F.col("start") >= 0) & (F.col("start") < F.col("length") + flank + 1)).drop("length")
    counts = rows.groupBy("chrom", "start", "strand", "condition").agg(F.count("*").cast("double").alias("value"))
    return counts.select("chrom", "start", (F.col("start") + 1).alias("end"), "strand", "condition", "value")


# -- features of BED files

SCORE_MODES = ("score", "score_category", "categorical", "name_category")


def feature_values(features: DataFrame, mode: str = "binary") -> DataFrame:
    """Adds ``value`` (double) and ``category`` (string) by the mode; any other mode takes names as categories."""
    none = F.lit(None)
    if mode == "binary":
        value, category = F.lit(1.0), none.cast("string")
    elif mode == "bedgraph":
        value, category = F.col("score").cast("double"), none.cast("string")
    elif mode == "score":
        value, category = F.col("score").cast("int").cast("double"), none.cast("string")
    elif mode in ("score_category", "categorical"):
        value, category = F.lit(1.0), F.col("score").cast("string")
    else:
        value, category = F.lit(1.0), F.col("name").cast("string")
    return features.withColumns({"value": value, "category": category})


def check_scores(features: DataFrame, mode: str) -> None:
    """Raises if the first row of a file has no score and the mode needs one."""
    if mode in SCORE_MODES:
        first = features.orderBy("ord").select("score").first()
        if first and first[0] == ".":
            raise ValueError(f"mode {mode} needs scores")


def categories(features: DataFrame, mode: str) -> list[str]:
    """Distinct categories as sorted strings."""
    return [r[0] for r in feature_values(features, mode).select("category").distinct().orderBy("category").collect()]


def paint(features: DataFrame, values: list[str] = ("value",), by: list[str] = (), bin_size: int | None = None) -> DataFrame:
    """Disjoint runs of overlapping features, where the last row in file order wins each position.

    Features are cut at bin borders, and in each bin their borders make elementary segments. A feature's part of a bin is laid
    on the few nodes of a binary tree that make it up (two a level at most), and each node keeps its last feature: that is
    aggregated where the features are read, so what is shuffled has a row a node and not a row a feature. A segment looks
    at the nodes above its first position, and the latest of them wins. No feature is paired with the segments it covers.
    """
    by, values = list(by), list(values)
    size = bin_size or suggest_bin(features)
    depth = max(size - 1, 0).bit_length()
    at = F.explode(F.sequence(floor_div(F.col("start"), size), floor_div(F.col("end") - 1, size))).alias("_bin")
    cut = features.where("end > start").select("chrom", *by, "ord", *values, at, "start", "end")
    low = F.col("_bin") * size
    cut = cut.withColumns({"start": F.greatest(F.col("start") - low, F.lit(0)), "end": F.least(F.col("end") - low, F.lit(size))})
    cell = ["chrom", *by, "_bin"]
    borders = cut.select(*cell, F.explode(F.array("start", "end")).alias("_s")).distinct()
    segments = borders.withColumn("_e", F.lead("_s").over(Window.partitionBy(*cell).orderBy("_s"))).where("_e is not null")
    above = F.explode(F.array(*(F.shiftright(F.col("_s") + (1 << depth), k) for k in range(depth + 1)))).alias("_node")
    asked = segments.select(*cell, "_s", "_e", above)
    nodes = []
    for k in range(depth + 1):
        first, last = F.shiftright(F.col("start") + ((1 << k) - 1), k), F.shiftright("end", k)
        odd = lambda x: (x.bitwiseAND(1) == 1) & (first < last)
        nodes += [F.when(odd(x), (1 << (depth - k)) + place) for x, place in ((first, first), (last, last - 1))]
    laid = cut.withColumn("_node", F.explode(F.array(*nodes))).where("_node is not null")
    here = [*cell, "_node"]
    if all(isinstance(features.schema[v].dataType, (NumericType, BooleanType)) for v in values):  # aggregated by hash
        held = laid.groupBy(*here).agg(F.max("ord").alias("_ord"), *(F.max_by(v, "ord").alias(v) for v in values))
        won = asked.join(held, here).groupBy(*cell, "_s", "_e").agg(*(F.max_by(v, "_ord").alias(v) for v in values))
    else:  # strings would be aggregated by sorting: only the rows of winners are looked up
        held = laid.groupBy(*here).agg(F.max("ord").alias("_ord"))
        best = asked.join(held, here).groupBy(*cell, "_s", "_e").agg(F.max("_ord").alias("ord"))
        won = best.join(cut, [*cell, "ord"]).where((F.col("start") <= F.col("_s")) & (F.col("_e") <= F.col("end")))
        won = won.groupBy(*cell, "_s", "_e").agg(F.first(F.struct(*values)).alias("_v")).select(*cell, "_s", "_e", *(F.col(f"_v.{v}").alias(v) for v in values))
    return won.select("chrom", (low + F.col("_s")).alias("start"), (low + F.col("_e")).alias("end"), *by, *values)


def feature_track(features: DataFrame, mode: str = "binary", condition: str = "signal", conditions: list[str] | None = None, bin_size: int | None = None) -> DataFrame:
    """Painted runs. In category modes each category is a condition of ones; others than ``conditions`` are left out."""
    rows = feature_values(features, mode)
    if mode in ("binary", "score", "bedgraph"):
        return paint(rows, bin_size=bin_size).select("chrom", "start", "end", F.lit(0).alias("strand"), F.lit(condition).alias("condition"), "value")
    out = paint(rows, ["value", "category"], bin_size=bin_size)
    out = out.select("chrom", "start", "end", F.lit(0).alias("strand"), F.col("category").alias("condition"), "value")
    return out.where(F.col("condition").isin(conditions)) if conditions is not None else out


def with_minoverlap(windows: DataFrame, runs: DataFrame, minoverlap: float | None, bin_size: int | None = None) -> DataFrame:
    """Windows that overlap some run, and of which at least a share ``minoverlap`` has a signal that isn't 0."""
    if minoverlap is None:
        return overlap_semi(windows, runs, "idx", bin_size)
    met = overlap_join(windows.select("idx", "chrom", "start", "end"), runs.where("value <> 0").select("chrom", "start", "end"), bin_size)
    cover = met.groupBy("idx", "start", "end").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("_n"))
    return windows.join(cover.where(F.col("_n") / (F.col("end") - F.col("start")) >= minoverlap).select("idx"), "idx", "left_semi")


# -- reading a track per window

def window_runs(windows: DataFrame, track: DataFrame, bin_size: int | None = None) -> DataFrame:
    """(idx, length, wstrand, s, e, strand, condition, value): runs clipped to windows, in window positions."""
    met = overlap_join(windows.select("idx", "chrom", "start", "end", F.col("strand").alias("wstrand")), track, bin_size)
    return met.select("idx", (F.col("end") - F.col("start")).alias("length"), "wstrand", (F.greatest("start", "r_start") - F.col("start")).alias("s"), (F.least("end", "r_end") - F.col("start")).alias("e"), F.col("r_strand").alias("strand"), F.col("r_condition").alias("condition"), F.col("r_value").alias("value"))


def collapse(clipped: DataFrame, resolution: int | None, how: str | Callable, stranded: bool = False, tail: str = "cycle", background: float = 0.0) -> DataFrame:
    """(idx, bin, strand, condition, value): window positions reduced per bin of ``resolution``, or per window for None.

    Sums add over strands where not ``stranded``. Means divide by all positions of the bin and the greatest value
    counts those without a run, as ``background``. A window that isn't a multiple of ``resolution`` long repeats
    its own first positions up to the next multiple; with ``tail='zero'`` the background follows instead.
    A callable gets a (positions, strands) array of a bin.
    """
    if not callable(how) and how not in COLLAPSERS:
        raise ValueError(f"unknown collapser {how}")
    rows = clipped
    strand = F.col("strand") if stranded else F.lit(0)
    if resolution is None:
        rows = rows.select("idx", F.lit(0).cast("long").alias("bin"), F.col("length").alias("width"), strand.alias("strand"), "condition", "value", "s", "e")
    else:
        if tail == "cycle":
            extra = ceil_div(F.col("length"), resolution) * resolution - F.col("length")
            # only the last bin repeats, and never more than one bin: a window shorter than that repeats from its start again
            again = rows.where((extra > 0) & (F.col("s") < extra))
            turns = F.explode(F.sequence(F.lit(1).cast("long"), ceil_div(extra, F.col("length")))).alias("_turn")
            whole = ceil_div(F.col("length"), resolution) * resolution
            again = again.select("*", turns).withColumns({"s": F.col("s") + F.col("length") * F.col("_turn"), "e": F.least(F.col("e") + F.col("length") * F.col("_turn"), whole)}).drop("_turn").where("s < e")
            rows = rows.unionByName(again)
        bins = F.explode(F.sequence(floor_div(F.col("s"), resolution), floor_div(F.col("e") - 1, resolution))).alias("bin")
        rows = rows.select("idx", bins, F.lit(resolution).cast("long").alias("width"), strand.alias("strand"), "condition", "value", "s", "e")
        rows = rows.withColumns({"s": F.greatest(F.col("s"), F.col("bin") * resolution), "e": F.least(F.col("e"), (F.col("bin") + 1) * resolution)})
    key = ["idx", "bin", "strand", "condition"]
    n = F.col("e") - F.col("s")
    if callable(how):
        return _collapse_by(rows, key, how)
    if how == "max":
        strands = F.count_distinct("strand") if stranded else F.lit(1)
        cover = F.sum(n)
        top = F.max("value")
        out = rows.groupBy(*key).agg(top.alias("_top"), cover.alias("_n"), F.max("width").alias("_w"), strands.alias("_s"))
        return out.select(*key, F.when(F.col("_n") < F.col("_w"), F.greatest(F.col("_top"), F.lit(background))).otherwise(F.col("_top")).alias("value"))
    total = F.sum((F.col("value") - background) * n) + F.max("width") * background
    value = total if how == "sum" else total / F.max("width")
    return rows.groupBy(*key).agg(value.alias("value"))


def _collapse_by(rows: DataFrame, key: list[str], how: Callable) -> DataFrame:
    """A user's function over a bin's positions: Arrow batches of groups that are one bin large."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        low = int(pdf["bin"].iloc[0]) * width
        held = np.zeros((width, 1))
        for s, e, v in zip(pdf["s"], pdf["e"], pdf["value"]):
            held[int(s) - low : int(e) - low, 0] = v
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in key}, "value": float(np.squeeze(how(held)))}])

    ship(rows.sparkSession)
    return rows.groupBy(*key).applyInPandas(run, "idx long, bin long, strand int, condition string, value double")


def oriented(cells: DataFrame, windows: DataFrame, resolution: int | None, stranded: bool = False) -> DataFrame:
    """Cells as read: windows on the minus strand are turned around along positions and strands."""
    rows = cells.join(windows.select("idx", "strand", (F.col("end") - F.col("start")).alias("_len")).withColumnRenamed("strand", "_ws"), "idx")
    bins = F.lit(1).cast("long") if resolution is None else ceil_div(F.col("_len"), resolution)
    minus = F.col("_ws") == "-"
    out = rows.withColumn("bin", F.when(minus, bins - 1 - F.col("bin")).otherwise(F.col("bin")))
    if stranded:
        out = out.withColumn("strand", F.when(minus, 1 - F.col("strand")).otherwise(F.col("strand")))
    return out.drop("_ws", "_len")


def dense(cells: DataFrame, windows: DataFrame, bins: int, conditions: list[str], strands: int = 1, fill: float | DataFrame = 0.0) -> DataFrame:
    """(idx, values): each window's cells as a flat array, in the order (bin, strand, condition).

    ``fill`` is what cells that aren't there are: a number, or (condition, background) rows.
    """
    at = F.create_map(*[x for i, c in enumerate(conditions) for x in (F.lit(c), F.lit(i))]) if conditions else F.lit(None)
    place = (F.col("bin") * strands + F.col("strand")) * len(conditions) + at[F.col("condition")]
    held = cells.where(F.col("condition").isin(conditions) & (F.col("bin") < bins)).select("idx", place.cast("int").alias("_p"), "value")
    packed = held.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("_p", "value"))).alias("_m"))
    size = bins * strands * len(conditions)
    rows = windows.select("idx")
    if isinstance(fill, DataFrame):
        known = fill.agg(F.map_from_entries(F.collect_list(F.struct("condition", "background"))).alias("_f"))  # one row
        rows = rows.crossJoin(F.broadcast(known)).select("idx", F.array(*(F.coalesce(F.element_at("_f", F.lit(c)), F.lit(0.0)) for c in conditions)).alias("_f"))
    else:
        rows = rows.withColumn("_f", F.array_repeat(F.lit(float(fill)), len(conditions)))
    values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.get("_f", F.pmod(i, F.lit(len(conditions))))))
    empty = F.flatten(F.array_repeat("_f", bins * strands))
    return rows.join(packed, "idx", "left").select("idx", F.when(F.col("_m").isNull(), empty).otherwise(values).alias("values"))


# -- whole tracks

def total(track: DataFrame) -> DataFrame:
    """(condition, total) over all positions and strands."""
    return track.groupBy("condition").agg(F.sum(F.col("value") * (F.col("end") - F.col("start"))).alias("total"))


def cell_count(sizes: DataFrame, resolution: int = 1, strands: int = 1) -> Column:
    """The number of stored cells of a genome, as a scalar."""
    return sizes.agg((F.sum(ceil_div(F.col("length"), resolution)) * strands).alias("cells"))


def moments(track: DataFrame, cells: DataFrame) -> DataFrame:
    """(condition, mean, sd) over all cells, those without a run counting as 0; sd is that of the centred values."""
    n = F.col("end") - F.col("start")
    sums = track.groupBy("condition").agg(F.sum(F.col("value") * n).alias("_s"), F.sum(F.col("value") * F.col("value") * n).alias("_q"))
    mean = F.col("_s") / F.col("cells")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_q") - F.col("cells") * mean * mean, F.col("cells") - 1)))
    return sums.crossJoin(F.broadcast(cells)).select("condition", mean.alias("mean"), sd.alias("sd"))  # cells is one row


def region_reads(intervals: DataFrame, track: DataFrame, bin_size: int | None = None) -> DataFrame:
    """Interval access: a track's runs within query intervals (key idx) at nucleotide resolution, as runs in query positions."""
    return window_runs(intervals, track, bin_size)


def from_windows(cells: DataFrame, windows: DataFrame, resolution: int, bin_size: int | None = None) -> DataFrame:
    """Runs of windows' cells; where windows overlap, the last window wins."""
    rows = cells.join(windows.select("idx", "chrom", "start", "end"), "idx")
    s = F.col("start") + F.col("bin") * resolution
    rows = rows.select("chrom", s.alias("start"), F.least(s + resolution, F.col("end")).alias("end"), F.col("idx").alias("ord"), "strand", "condition", "value")
    return paint(rows, ["value"], ["strand", "condition"], bin_size).select("chrom", "start", "end", "strand", "condition", "value")
