"""Tiling of regions into windows.

A window set is a DataFrame (idx, chrom, start, end, strand) with the parameters that made it. Coordinates are those
of the tile; ``flanked`` extends them (the start no lower than 0) as readers do.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import floor_div, require, running_total


def tile(regions: DataFrame, binsize: int, stepsize: int | None = None, zero_padding: bool = True) -> DataFrame:
    """(chrom, start, end, strand, ord, k): the k-th window of each region.

    Windows start every ``stepsize`` positions; with ``zero_padding``, positions that are left over make one more
    window that ends with the region. A region shorter than a window may so begin before its own start, and a
    step beyond the window size may leave a tail longer than a window.
    """
    return _tiles(_tiled(regions, binsize, stepsize, zero_padding), binsize, stepsize)


def _tiled(regions: DataFrame, binsize: int, stepsize: int | None, zero_padding: bool) -> DataFrame:
    """Regions that have windows, with _n: the full ones (negative where the tail begins before its region), and _m: all."""
    step = binsize if stepsize is None else stepsize
    length = F.col("end") - F.col("start")
    room = length - binsize + step if step <= binsize else length
    n = floor_div(room, step)
    tail = F.when(F.pmod(room, F.lit(step)) > 0, 1).otherwise(0) if zero_padding else F.lit(0)
    strand = F.coalesce(F.col("strand"), F.lit(".")) if "strand" in regions.columns else F.lit(".")
    rows = regions.select("chrom", "start", "end", strand.alias("strand"), "ord", n.alias("_n"))
    return rows.withColumn("_m", (F.greatest("_n", F.lit(0)) + tail).cast("int")).where("_m > 0")


def _tiles(rows: DataFrame, binsize: int, stepsize: int | None, *more: str) -> DataFrame:
    """The windows of what ``_tiled`` gives; only their numbers are exploded, and no array of windows is made."""
    step = binsize if stepsize is None else stepsize
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    tail = F.col("k") >= F.col("_n")
    start = F.col("start") + F.when(tail, F.col("_n")).otherwise(F.col("k").cast("long")) * step
    end = F.when(tail, F.col("end")).otherwise(F.col("start") + F.col("k") * step + binsize)
    return rows.select("chrom", start.alias("start"), end.alias("end"), "strand", "ord", "k", *more)


def numbered(tiles: DataFrame) -> DataFrame:
    """Adds ``idx``: the place of each window in the order of regions and of windows in them, from 0."""
    per = tiles.groupBy("ord").agg(F.count("*").alias("_n"))
    base = running_total(per, [], "ord", "_n", "_base").select("ord", "_base")
    return tiles.join(base, "ord").withColumn("idx", (F.col("_base") + F.col("k")).cast("long")).drop("_base")


def numbered_tiles(regions: DataFrame, binsize: int, stepsize: int | None = None, zero_padding: bool = True) -> DataFrame:
    """``numbered`` of ``tile``: the windows before a region are summed over regions, so that windows are made once and don't move."""
    rows = running_total(_tiled(regions, binsize, stepsize, zero_padding), [], "ord", "_m", "_base")
    return _tiles(rows, binsize, stepsize, "_base").withColumn("idx", (F.col("_base") + F.col("k")).cast("long")).drop("_base")


@dataclass(frozen=True)
class Windows:
    """A tiling and its parameters."""

    df: DataFrame
    binsize: int | None = None
    stepsize: int | None = None
    flank: int = 0
    zero_padding: bool = True
    collapse: bool = False
    random_state: int | None = None

    def __post_init__(self):
        for name in ("binsize", "stepsize"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, int) or value <= 0):
                raise ValueError(f"{name} must be a positive int")
        if not isinstance(self.flank, int) or self.flank < 0:
            raise ValueError("flank must be an int of at least 0")

    @classmethod
    def create_from_file(cls, regions: DataFrame, binsize: int | None = None, stepsize: int | None = None, flank: int = 0, zero_padding: bool = True, collapse: bool = False, random_state: int | None = None) -> Windows:
        """Tiles all regions. Without a binsize, it is the longest region's length, or each region is one window with ``collapse``."""
        require(regions, ["chrom", "start", "end", "ord"], "regions")
        if binsize is None and collapse:
            strand = F.coalesce(F.col("strand"), F.lit(".")) if "strand" in regions.columns else F.lit(".")
            tiles = regions.select("chrom", "start", "end", strand.alias("strand"), "ord", F.lit(0).alias("k"))
            made = cls(numbered(tiles), None, stepsize or 1, flank, zero_padding, True, random_state)
        else:
            size = binsize or infer_binsize(regions)
            cls(regions, size, stepsize, flank)
            made = cls(numbered_tiles(regions, size, stepsize, zero_padding), size, stepsize or size, flank, zero_padding, collapse, random_state)
        return made.shuffled() if random_state is not None else made

    @classmethod
    def create_from_genomesize(cls, sizes: DataFrame) -> Windows:
        """One window a chromosome, of (chrom, length) rows."""
        rows = sizes.withColumn("ord", F.coalesce(F.col("ord"), F.lit(0)) if "ord" in sizes.columns else F.xxhash64("chrom"))
        rows = rows.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(".").alias("strand"), "ord", F.lit(0).alias("k"))
        return cls(numbered(rows), None, 1, 0, False)

    @classmethod
    def create_from_region(cls, spark: SparkSession, chrom: str, start: int, end: int, strand: str = ".", binsize: int | None = None, stepsize: int | None = None, flank: int = 0, zero_padding: bool = True) -> Windows:
        row = spark.createDataFrame([(chrom, start, end, strand, 0)], "chrom string, start long, end long, strand string, ord long")
        return cls.create_from_file(row, binsize or end - start, stepsize, flank, zero_padding)

    def add(self, other: Windows) -> Windows:
        """This tiling followed by the other's windows, which are tiled again by this one's parameters."""
        last = self.df.agg(F.max("ord")).first()[0]
        again = other.df.select("chrom", "start", "end", "strand", (F.col("idx") + F.lit((last if last is not None else -1) + 1)).alias("ord"))
        tiles = tile(again, self.binsize, self.stepsize, self.zero_padding) if self.binsize else again.withColumn("k", F.lit(0))
        return replace(self, df=numbered(self.df.drop("idx").unionByName(tiles)))

    def at(self, idx: int | slice | list[int]) -> DataFrame:
        """Windows by place; negative places count from the end."""
        if isinstance(idx, slice) or (isinstance(idx, int) and idx < 0) or (isinstance(idx, list) and min(idx, default=0) < 0):
            n = len(self)
            idx = list(range(*idx.indices(n))) if isinstance(idx, slice) else [i % n for i in ([idx] if isinstance(idx, int) else idx)]
        if isinstance(idx, bool) or not isinstance(idx, (int, list)):
            raise IndexError("an int, a slice or a list of ints is needed")
        return self.flanked().where(F.col("idx").isin([idx] if isinstance(idx, int) else idx))

    def __len__(self) -> int:
        return self.df.count()

    def flanked(self) -> DataFrame:
        """Windows as they are read: extended by the flank, starts no lower than 0, empty ones one position long."""
        start, end = F.greatest(F.lit(0), F.col("start") - self.flank), F.col("end") + self.flank
        return self.df.withColumns({"start": start, "end": F.when(end == start, end + 1).otherwise(end)})

    def shuffled(self) -> Windows:
        """Windows renumbered by a seeded order."""
        order = self.df.withColumn("_h", F.xxhash64(F.lit(self.random_state or 0), "idx"))
        ranked = running_total(order.withColumn("_one", F.lit(1)), [], "_h", "_one", "_place", block=1 << 48)
        return replace(self, df=ranked.withColumn("idx", F.col("_place").cast("long")).drop("_h", "_one", "_place"))

    def where(self, include=None, exclude=None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows by chromosome and range: those whose flanked window reaches beyond ``start`` and begins before ``end``."""
        listed = lambda x: [x] if isinstance(x, str) else list(x)
        out = self.df
        if include:
            out = out.where(F.col("chrom").isin(listed(include)))
        if exclude:
            out = out.where(~F.col("chrom").isin(listed(exclude)))
        if start is not None:
            out = out.where(F.col("end") + self.flank > start)
        if end is not None:
            out = out.where(F.col("start") - self.flank < end)
        return out

    def filter_by_region(self, include=None, exclude=None, start: int | None = None, end: int | None = None) -> Windows:
        """The same tiling over fewer windows, numbered anew."""
        kept = self.where(include, exclude, start, end).withColumns({"ord": F.col("idx"), "k": F.lit(0)}).drop("idx")
        made = replace(self, df=numbered(kept))
        return made.shuffled() if self.random_state is not None else made

    def check(self, resolution: int | None, whole_genome: bool) -> None:
        """Raises if stored bins of a whole genome can't serve these windows."""
        if whole_genome and resolution and resolution > 1:
            if self.binsize is not None and self.binsize % resolution:
                raise ValueError("binsize must be a multiple of resolution")
            if not self.df.where(F.pmod(F.col("start"), F.lit(resolution)) != 0).isEmpty():
                raise ValueError("window starts must be multiples of resolution: trim the regions")

    def labels(self) -> DataFrame:
        return self.flanked().select("idx", interval_label())

    def to_bed(self) -> DataFrame:
        """Six BED columns, flanked, in order."""
        return self.flanked().select("chrom", "start", "end", F.lit("-").alias("name"), F.lit("-").alias("score"), "strand", "idx").orderBy("idx").drop("idx")


def infer_binsize(regions: DataFrame) -> int:
    return regions.agg(F.max(F.col("end") - F.col("start"))).first()[0]


def interval_label() -> Column:
    return F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("label")


def parse_label(label: Column) -> Column:
    """struct<chrom, start, end> of 'chr:start-end'; the start may be negative; nulls where it doesn't parse or names a chromosome only."""
    pattern = r"^([^:]+):(-?\d+)-(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(label, pattern, i), F.lit(""))
    return F.struct(F.coalesce(part(1), F.when(~F.contains(label, F.lit(":")), label)).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def trim_to_multiple(regions: DataFrame, by: int) -> DataFrame:
    """Starts up and ends down to multiples of ``by``; a missing score becomes 0."""
    out = regions.withColumns({"start": -floor_div(-F.col("start"), by) * by, "end": floor_div(F.col("end"), by) * by})
    return out.withColumn("score", F.coalesce("score", F.lit("0"))) if "score" in regions.columns else out


def genome_size(regions: DataFrame) -> DataFrame:
    """(chrom, length, ord): the greatest end of each chromosome, and its first row."""
    return regions.groupBy("chrom").agg(F.max("end").alias("length"), F.min("ord").alias("ord"))
