"""Datasets: windows over a signal or a sequence, and arrays.

Everything stays a lazy DataFrame until rows are asked for: ``cells`` and ``rows`` are the data, and indexing collects
the few windows that a caller wants as an array.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as Q
from .operators import access, normalize, tensor, track, variants
from .operators.windows import Windows, genome_size
from .schema import ceil_div, floor_div
from .sources import ranged, sinks
from .sources.bam import bam_sizes, read_bam
from .sources.bigwig import bigwig_sizes, read_bigwig
from .sources.fasta import fixed_length, read_fasta, sizes as fasta_sizes
from .sources.intervals import as_intervals, check_files, read_bed, read_bedgraph, read_vcf, stem


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _collected(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    held = rows.orderBy("idx").collect()
    return np.array([r["values"] for r in held], float).reshape((len(held), *shape[1:]))


class Dataset:
    """What models read: a name, a shape, a length, and rows by place."""

    name: str

    def __len__(self) -> int:
        return self.shape[0]

    def rows(self) -> DataFrame:
        """(idx, values): a flat, row-major array a window."""
        raise NotImplementedError

    def __getitem__(self, idx) -> np.ndarray:
        if isinstance(idx, (int, np.integer)):
            idx = [int(idx)]
        if isinstance(idx, slice):
            idx = list(range(*idx.indices(len(self))))
        try:
            wanted = [int(i) for i in idx]
        except TypeError as e:
            raise IndexError("an int, a slice or a list of ints is needed") from e
        n = len(self)
        wanted = [i % n if i < 0 else i for i in wanted]
        held = {r["idx"]: r["values"] for r in self.rows().where(F.col("idx").isin(wanted)).collect()}
        return np.array([held[i] for i in wanted], float).reshape((len(wanted), *self.shape[1:]))


def _checked_name(name) -> str:
    if not isinstance(name, str):
        raise ValueError("a dataset's name must be a string")
    return name


def _windows(roi, binsize, stepsize, flank, resolution, zero_padding, random_state, sizes: DataFrame | None = None) -> Windows | None:
    if roi is None:
        return Windows.create_from_genomesize(sizes) if sizes is not None else None
    if isinstance(roi, Windows):
        return roi
    regions = as_intervals(_session(), roi)
    return Windows.create_from_file(regions, binsize, stepsize, flank, zero_padding, resolution is None, random_state)


#: Parameters of array stores, which tables don't need: taken, without effect.
NEEDLESS = {"storage", "dtype", "verbose"}


@dataclass(frozen=True)
class Cache:
    """Where a dataset's table is kept: ``cache`` is True (the output folder), a folder that all executors see, or False.

    A table is made anew where its files or parameters differ, or with ``overwrite``; ``datatags`` name subfolders.
    """

    folder: str | None
    overwrite: bool = False

    @classmethod
    def of(cls, name: str, more: dict) -> Cache:
        if unknown := more.keys() - NEEDLESS - {"cache", "overwrite", "datatags"}:
            raise TypeError(f"unknown parameters: {', '.join(sorted(unknown))}")
        _checked_name(name)
        where, tags = more.get("cache", False), more.get("datatags") or [name]
        root = sinks.output_folder() if where is True else where
        return cls("/".join([root, "datasets", *([tags] if isinstance(tags, str) else tags)]) if where else None, bool(more.get("overwrite")))

    def table(self, sources: list, parts: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, or the table kept for the same files, bytes of arrays and parameters."""
        if self.folder is None:
            return make()
        if any(isinstance(s, DataFrame) for s in sources):
            raise ValueError("a DataFrame's rows can't be told from changed ones: write it, or leave out cache")
        paths = lambda s: isinstance(s, str) or isinstance(s, (list, tuple)) and all(isinstance(x, str) for x in s)
        held = [ranged.stamps(_session(), s) if paths(s) else s for s in sources]
        return sinks.cached(_session(), self.folder, sinks.cache_key(parts, held), make, self.overwrite)


@dataclass(frozen=True)
class Cover(Dataset):
    """Signal per window, bin, strand and condition."""

    name: str
    signal: DataFrame
    windows: Windows | None
    conditions: tuple[str, ...]
    resolution: int | None = 1
    collapser: str | Callable = "sum"
    stranded: bool = False
    normalizers: tuple = ()
    sizes: DataFrame | None = None
    whole_genome: bool = False
    minoverlap: float | None = None
    only_overlapping: bool = False
    padding_value: float = 0.0
    tail: str = "cycle"
    #: What reads the signal near windows, where files can be read in part.
    source: Callable[[Windows], DataFrame] | None = None

    def __post_init__(self):
        _checked_name(self.name)
        if not callable(self.collapser) and self.collapser not in track.COLLAPSERS:
            raise ValueError(f"unknown collapser {self.collapser}")
        if self.windows is not None:
            self.windows.check(self.resolution, self.whole_genome)
        elif not self.whole_genome:
            raise ValueError("regions are needed unless the whole genome is stored")

    # -- sources

    @classmethod
    def create_from_bam(cls, name, bamfiles, roi=None, genomesize=None, conditions=None, min_mapq=None, binsize=None, stepsize=None, flank=0, resolution=1, stranded=True, pairedend="5prime", template_extension=0, normalizer=None, zero_padding=True, random_state=None, store_whole_genome=False, reads: DataFrame | None = None, **more):
        """Read counts of BAM files, or of a table of ``reads`` with a condition column. ``template_extension`` has no effect.

        Of indexed files only the windows' chromosomes are read: a read may count far away, at the end of its pair.
        """
        spark, files, cache = _session(), None if reads is not None else check_files(bamfiles), Cache.of(name, more)
        if template_extension:
            warnings.warn("template_extension has no effect: reads count wherever they lie", stacklevel=2)
        if reads is None:
            conditions = list(conditions or map(stem, files))
        sizes = _sizes(genomesize) if genomesize is not None else bam_sizes(spark, files) if files else None

        def signal_near(near: Windows | None) -> DataFrame:
            held = reads
            if held is None:
                chroms = None if near is None else [(c, 0, 1 << 29) for (c,) in near.df.select("chrom").distinct().collect()]  # a row a chromosome
                held = _united([read_bam(spark, f, chroms).withColumn("condition", F.lit(c)) for f, c in zip(files, conditions)])
            return track.read_track(held, F.col("condition"), min_mapq, pairedend, stranded, None if store_whole_genome else sizes, flank)

        windows = _windows(roi, binsize, stepsize, flank, resolution, zero_padding, random_state, sizes if store_whole_genome else None)
        part = reads is None and cache.folder is None and not store_whole_genome and windows is not None
        parts = {"of": "bam", "conditions": list(conditions), "mapq": min_mapq, "pairs": pairedend, "stranded": stranded, "whole": store_whole_genome, "flank": flank}
        if cache.folder and sizes is not None:
            parts["sizes"] = sorted(map(tuple, sizes.select("chrom", "length").collect()))  # a row a chromosome
        signal = signal_near(windows) if part else cache.table(files if reads is None else [reads], parts, lambda: signal_near(None))
        return cls(name, signal, windows, tuple(conditions), resolution, "sum", stranded, _names(normalizer), sizes, store_whole_genome, source=signal_near if part else None)

    @classmethod
    def create_from_bigwig(cls, name, bigwigfiles, roi=None, genomesize=None, conditions=None, binsize=None, stepsize=None, resolution=1, flank=0, collapser=None, normalizer=None, zero_padding=True, random_state=None, store_whole_genome=False, nan_to_num=True, **more):
        """Signal of BIGWIG files, of which only blocks near the windows are read unless the whole genome is stored."""
        spark, files, cache = _session(), check_files(bigwigfiles), Cache.of(name, more)
        conditions = list(conditions or map(stem, files))

        def signal_near(near: Windows | None) -> DataFrame:
            regions = None if near is None else ranged.reach(near.flanked())
            one = lambda f, c: read_bigwig(spark, f, nan_to_num, regions).select("chrom", "start", "end", F.lit(0).alias("strand"), F.lit(c).alias("condition"), "value")
            return _united([one(f, c) for f, c in zip(files, conditions)])

        sizes = _sizes(genomesize) if genomesize is not None else bigwig_sizes(spark, files)
        windows = _windows(roi, binsize, stepsize, flank, resolution, zero_padding, random_state, sizes if store_whole_genome else None)
        part = cache.folder is None and not store_whole_genome and windows is not None
        signal = signal_near(windows) if part else cache.table(files, {"of": "bigwig", "conditions": conditions, "nan": nan_to_num}, lambda: signal_near(None))
        return cls(name, signal, windows, tuple(conditions), resolution, collapser or "mean", False, _names(normalizer), sizes, store_whole_genome, source=signal_near if part else None)

    @classmethod
    def create_from_bed(cls, name, bedfiles, roi=None, genomesize=None, conditions=None, binsize=None, stepsize=None, resolution=1, flank=0, mode="binary", collapser=None, normalizer=None, minoverlap=None, zero_padding=True, random_state=None, store_whole_genome=False, **more):
        """Features as signal; modes 'binary', 'score', 'bedgraph', 'categorical' or 'score_category', and 'name_category'."""
        spark, cache = _session(), Cache.of(name, more)
        files = [bedfiles] if isinstance(bedfiles, DataFrame) else check_files(bedfiles)
        read = lambda f: as_intervals(spark, f) if isinstance(f, DataFrame) else (read_bedgraph if mode == "bedgraph" else read_bed)(spark, f)
        features = [read(f) for f in files]
        for f in features:
            track.check_scores(f, mode)
        plain = mode in ("binary", "score", "bedgraph")
        if plain:
            conditions = list(conditions or [stem(f) if isinstance(f, str) else f"signal{i}" for i, f in enumerate(files)])
        else:
            if len(features) > 1 and conditions is None:
                raise ValueError("categories are taken from a single file: give conditions")
            conditions = list(conditions or track.categories(features[0], mode))
        made = lambda: _united([track.feature_track(f, mode, c or "signal", None if plain else conditions) for f, c in zip(features, conditions if plain else [None] * len(features))])
        signal = cache.table(files, {"of": "bed", "conditions": conditions, "mode": mode}, made)
        sizes = _sizes(genomesize) if genomesize is not None else genome_size(features[0] if len(features) == 1 else features[0].unionByName(features[1], allowMissingColumns=True))
        windows = _windows(roi, binsize, stepsize, flank, resolution, zero_padding, random_state, sizes if store_whole_genome else None)
        return cls(name, signal, windows, tuple(conditions), resolution, collapser or "max", False, _names(normalizer), sizes, store_whole_genome, minoverlap, True)

    @classmethod
    def create_from_array(cls, name, array, gindexer: Windows, genomesize=None, conditions=None, resolution=None, padding_value=0.0, store_whole_genome=False, **more):
        """Values (windows, positions[, strands], conditions) of windows."""
        cache = Cache.of(name, more)
        a = np.asarray(array, float)
        n = len(gindexer)
        if len(a) != n:
            raise ValueError(f"{len(a)} rows for {n} windows")
        if store_whole_genome and gindexer.stepsize and gindexer.binsize and gindexer.binsize > gindexer.stepsize:
            raise ValueError("overlapping windows can't be stored as a whole genome")
        stranded = a.ndim == 3 and a.shape[2] == 2
        a = a.reshape(n, 1, 1, 1) if a.ndim == 1 else a.reshape(n, a.shape[1], 1, 1) if a.ndim == 2 else a.reshape(*a.shape, 1) if stranded else a.reshape(n, a.shape[1], 1, a.shape[2]) if a.ndim == 3 else a
        strands = a.shape[2]
        conditions = list(conditions or [f"Cond_{i}" for i in range(a.shape[3])])
        if len(conditions) != a.shape[3]:
            raise ValueError("a condition for each of the last dimension is needed")
        resolution = resolution or max(1, (gindexer.binsize or a.shape[1]) // a.shape[1])
        spark = _session()
        rows = spark.createDataFrame([(i, list(map(float, x.reshape(-1)))) for i, x in enumerate(a)], "idx long, values array<double>")
        names = F.array(*map(F.lit, conditions))
        cells = tensor.unstack(rows, a.shape[1:]).select("idx", F.col("pos").cast("long").alias("bin"), "strand", F.get(names, F.col("condition")).alias("condition"), "value")
        parts = {"of": "array", "conditions": conditions, "resolution": resolution, "shape": a.shape}
        places = [] if cache.folder is None else [tuple(map(str, r)) for r in gindexer.flanked().select("idx", "chrom", "start", "end", "strand").orderBy("idx").collect()]  # as long as the array
        signal = cache.table([hashlib.sha256(a.tobytes()).hexdigest().encode(), places], parts, lambda: track.from_windows(cells, gindexer.flanked(), resolution))
        return cls(name, signal, gindexer, tuple(conditions), resolution, "mean", strands == 2, (), genome_size(gindexer.df.withColumn("ord", F.col("idx"))), store_whole_genome, padding_value=padding_value)

    # -- data

    @property
    def gindexer(self) -> Windows:
        if self.windows is None:
            raise ValueError("no windows yet: use with_windows")
        return self.windows

    def with_windows(self, windows: Windows) -> Cover:
        return replace(self, windows=windows, signal=self.source(windows) if self.source else self.signal)

    @property
    def strands(self) -> int:
        return 2 if self.stranded else 1

    @property
    def bins(self) -> int:
        w = self.gindexer
        if self.resolution is None:
            return 1
        size = w.binsize or w.df.agg(F.max(F.col("end") - F.col("start"))).first()[0]
        return max(1, -(-(size + 2 * w.flank) // self.resolution))

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return len(self.gindexer), self.bins, self.strands, len(self.conditions)

    def _selected(self) -> DataFrame:
        w = self.gindexer.flanked()
        if self.whole_genome or not self.only_overlapping:
            return w
        return track.with_minoverlap(w, self.signal.where("value is not null"), self.minoverlap)

    def _genome(self) -> normalize.Signal:
        """The stored bins of a whole genome, normalised."""
        w = Windows.create_from_genomesize(self.sizes).df
        runs = self.signal
        if self.resolution and self.resolution > 1:
            cells = track.collapse(track.window_runs(w, runs), self.resolution, self.collapser, self.stranded, "zero", self.padding_value)
            runs = track.from_windows(cells, w, self.resolution)
        size = self.resolution or 1
        if size == 1 or not self.normalizers:
            out = normalize.Signal.of(runs, self.sizes, 1, self.strands)
            return normalize.normalize(out, list(self.normalizers), size)
        # statistics are those of stored bins, so runs are counted in bins until they are normalised
        runs = runs.withColumns({"start": floor_div(F.col("start"), size), "end": ceil_div(F.col("end"), size)})
        out = normalize.normalize(normalize.Signal.of(runs, self.sizes, size, self.strands), list(self.normalizers), size)
        runs = out.runs.join(self.sizes.select("chrom", "length"), "chrom")
        runs = runs.withColumns({"start": F.col("start") * size, "end": F.least(F.col("end") * size, F.col("length"))}).drop("length")
        return replace(out, runs=runs)

    def _read(self) -> tuple[DataFrame, DataFrame | float]:
        """Cells as read, and what those that aren't there are: a number, or (condition, background) rows."""
        w = self.gindexer.flanked()
        fill: DataFrame | float = self.padding_value
        if self.whole_genome:
            genome = self._genome()
            how = self.collapser if self.resolution is None or self.resolution == 1 else "mean"
            if not self.normalizers or callable(how):
                out = track.collapse(track.window_runs(w, genome.runs), self.resolution, how, self.stranded, self.tail, self.padding_value)
            else:
                # collapsed as differences from the background, which is added again
                fill = genome.zero
                moved = genome.runs.join(F.broadcast(fill), "condition").withColumn("value", F.col("value") - F.col("background")).drop("background")
                out = track.collapse(track.window_runs(w, moved), self.resolution, how, self.stranded, self.tail, 0.0)
                size = w.select("idx", (F.col("end") - F.col("start") if self.resolution is None else F.lit(1)).alias("n") if how == "sum" else F.lit(1).alias("n"))
                out = out.join(F.broadcast(fill), "condition").join(size, "idx").withColumn("value", F.col("value") + F.col("background") * F.col("n")).drop("background", "n")
        else:
            out = track.collapse(track.window_runs(self._selected(), self.signal), self.resolution, self.collapser, self.stranded, self.tail, self.padding_value)
            if self.normalizers:
                runs = out.select("idx", "strand", "condition", "value", F.col("bin").alias("start"), (F.col("bin") + 1).alias("end"))
                size = w.agg((F.sum(F.greatest(F.lit(1), ceil_div(F.col("end") - F.col("start"), self.resolution or (1 << 40)))) * self.strands).alias("cells"))
                held = normalize.Signal(runs, size, runs.select("condition").distinct().withColumn("background", F.lit(0.0)))
                g = self.gindexer
                done = normalize.normalize(held, list(self.normalizers), (g.binsize or 1) + 2 * g.flank)
                out, fill = done.runs.select("idx", F.col("start").alias("bin"), "strand", "condition", "value"), done.zero
        return track.oriented(out, w, self.resolution, self.stranded), fill

    def cells(self) -> DataFrame:
        """(idx, bin, strand, condition, value) of all windows, as read; cells that aren't there are ``background``."""
        return self._read()[0]

    def background(self) -> DataFrame:
        """(condition, background): what normalisers have made of cells without signal."""
        fill = self._read()[1]
        if isinstance(fill, DataFrame):
            return fill
        return _session().createDataFrame([(c, float(fill)) for c in self.conditions], "condition string, background double")

    def rows(self) -> DataFrame:
        cells, fill = self._read()
        return track.dense(cells, self.gindexer.df, self.bins, list(self.conditions), self.strands, fill if self.normalizers else 0.0)

    def _bins_track(self, near: DataFrame | None = None) -> DataFrame:
        """The windows' bins as a track along the genome, those of background among them where normalisers moved it.

        ``near``: the flanked windows that are wanted, by idx.
        """
        w = self.gindexer.flanked()
        cells, fill = self._read()
        if near is not None:
            w, cells = near, cells.join(near.select("idx"), "idx", "left_semi")
        if isinstance(fill, DataFrame):
            names = F.array(*map(F.lit, self.conditions))
            values = track.dense(cells, w, self.bins, list(self.conditions), self.strands, fill)
            cells = tensor.unstack(values, (self.bins, self.strands, len(self.conditions))).select("idx", F.col("pos").cast("long").alias("bin"), "strand", F.get(names, F.col("condition")).alias("condition"), "value")
            size = w.select("idx", ceil_div(F.col("end") - F.col("start"), self.resolution or (1 << 40)).alias("_n"))
            cells = cells.join(size, "idx").where("bin < _n").drop("_n")
        return track.from_windows(track.oriented(cells, w, self.resolution, self.stranded), w, self.resolution or (1 << 40))

    def interval(self, chrom: str, start: int, end: int, strand: str = ".") -> np.ndarray:
        """(positions, strands, conditions) of an interval at nucleotide resolution; what no window covers is ``padding_value``."""
        row = _session().createDataFrame([(0, chrom, start, end, strand)], "idx long, chrom string, start long, end long, strand string")
        fill: DataFrame | float = self.padding_value
        if self.whole_genome:
            genome = self._genome()
            signal, fill = genome.runs, genome.zero if self.normalizers else fill
        else:
            signal = self._bins_track(self.gindexer.flanked().where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start)))
        cells = track.oriented(track.collapse(track.window_runs(row, signal), 1, "sum", self.stranded), row, 1, self.stranded)
        held = track.dense(cells, row, end - start, list(self.conditions), self.strands, fill).first()["values"]
        return np.array(held).reshape(end - start, self.strands, len(self.conditions))

    def view(self, regions) -> Cover:
        """The same signal under windows of other regions, tiled alike."""
        g = self.gindexer
        return self.with_windows(_windows(regions, g.binsize, g.stepsize, g.flank, self.resolution, g.zero_padding, g.random_state))

    def subset(self, include=None, exclude=None) -> Cover:
        if not include and not exclude:
            raise ValueError("include or exclude must be given")
        return self.with_windows(self.gindexer.filter_by_region(include, exclude))

    def export_to_bigwig(self, folder: str) -> None:
        """The cover's bins as they are read, normalised and at its resolution, without regard to windows' strands."""
        if self.whole_genome:
            genome = self._genome()
            signal = genome.runs
            if self.normalizers:
                # what no run covers is the background of its condition
                whole = self.sizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(-1).cast("long").alias("ord")).crossJoin(F.broadcast(genome.zero)).withColumnRenamed("background", "value")
                strands = F.explode(F.sequence(F.lit(0), F.lit(self.strands - 1))).alias("strand")
                painted = signal.withColumn("ord", F.lit(0).cast("long")).unionByName(whole.select("*", strands))
                signal = track.paint(painted, ["value"], ["strand", "condition"], 1 << 14)
        else:
            signal = self._bins_track()
        sinks.write_bigwigs(signal, self.sizes, folder, self.name)


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _names(normalizer) -> tuple:
    return () if not normalizer else tuple(normalizer) if isinstance(normalizer, (list, tuple)) else (normalizer,)


def _sizes(genomesize) -> DataFrame:
    """(chrom, length, ord) from a dict or a DataFrame."""
    if isinstance(genomesize, DataFrame):
        return genomesize if "ord" in genomesize.columns else genomesize.withColumn("ord", F.xxhash64("chrom"))
    return _session().createDataFrame([(c, n, i) for i, (c, n) in enumerate(genomesize.items())], "chrom string, length long, ord long")


@dataclass(frozen=True)
class Bioseq(Dataset):
    """k-mer indices per window; ``one_hot`` and indexing give one-hot arrays."""

    name: str
    sequences: DataFrame
    windows: Windows
    order: int = 1
    seqtype: str = "dna"
    whole_genome: bool = True

    def __post_init__(self):
        _checked_name(self.name)
        Q.alphabet(self.seqtype)

    @classmethod
    def create_from_refgenome(cls, name, refgenome, roi=None, binsize=None, stepsize=None, flank=0, order=1, store_whole_genome=False, zero_padding=True, random_state=None, **more):
        if roi is None and not store_whole_genome:
            raise ValueError("regions are needed unless the whole genome is stored")
        seqs = Cache.of(name, more).table([refgenome], {"of": "fasta"}, lambda: refgenome if isinstance(refgenome, DataFrame) else read_fasta(_session(), refgenome))
        windows = _windows(roi, binsize, stepsize, flank, 1, zero_padding, random_state, fasta_sizes(seqs))
        return cls(name, seqs, windows, order, "dna", store_whole_genome)

    @classmethod
    def create_from_seq(cls, name, fastafile, seqtype="dna", order=1, fixedlen=None, **more):
        """Each sequence of a file is a region of its own."""
        seqs = Cache.of(name, more).table([fastafile], {"of": "fasta"}, lambda: fastafile if isinstance(fastafile, DataFrame) else read_fasta(_session(), fastafile))
        seqs = fixed_length(seqs, fixedlen, seqtype)
        length = seqs.select(F.length("seq")).first()[0]
        windows = replace(Windows.create_from_genomesize(fasta_sizes(seqs)), binsize=length)
        return cls(name, seqs, windows, order, seqtype)

    @property
    def gindexer(self) -> Windows:
        return self.windows

    @property
    def conditions(self) -> list[str]:
        return Q.labels(self.order, self.seqtype)

    @property
    def length(self) -> int:
        w = self.windows
        size = w.binsize or w.df.agg(F.max(F.col("end") - F.col("start"))).first()[0]
        return size + 2 * w.flank - self.order + 1

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return len(self.windows), self.length, 1, len(Q.alphabet(self.seqtype)) ** self.order

    def kmers(self) -> DataFrame:
        """(idx, kmers): left-aligned, -1 where a letter is unknown or the window was cut."""
        rows = variants.with_context(self.windows.flanked(), variants.chunked(self.sequences), "idx")
        turned = F.when(F.col("strand") == "-", Q.reverse_complement(F.col("context"))).otherwise(F.col("context")) if self.seqtype == "dna" else F.col("context")
        held = Q.kmers(turned, self.order, self.seqtype)
        return rows.select("idx", F.transform(F.sequence(F.lit(0), F.lit(self.length - 1)), lambda i: F.coalesce(F.get(held, i), F.lit(-1))).alias("kmers"))

    def rows(self) -> DataFrame:
        return self.kmers().select("idx", F.flatten(Q.one_hot(F.col("kmers"), self.order, len(Q.alphabet(self.seqtype)))).alias("values"))

    def interval(self, chrom: str, start: int, end: int, strand: str = ".") -> str:
        """The letters of an interval."""
        if not self.whole_genome:
            raise ValueError("intervals can be read only where the whole genome is stored")
        row = _session().createDataFrame([(0, chrom, start, end)], "idx long, chrom string, start long, end long")
        seq = variants.with_context(row, variants.chunked(self.sequences), "idx").first()["context"]
        return seq[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")) if strand == "-" else seq

    def view(self, regions) -> Bioseq:
        g = self.windows
        return replace(self, windows=_windows(regions, g.binsize, g.stepsize, g.flank, 1, g.zero_padding, g.random_state))

    def subset(self, include=None, exclude=None) -> Bioseq:
        if not include and not exclude:
            raise ValueError("include or exclude must be given")
        return replace(self, windows=self.windows.filter_by_region(include, exclude))


class Array(Dataset):
    """Rows of an array, or of a DataFrame (idx, values) with a given shape."""

    def __init__(self, name: str, array, conditions: list[str] | None = None, shape: tuple[int, ...] | None = None):
        self.name = _checked_name(name)
        if isinstance(array, DataFrame):
            self._rows, self._shape = array, (array.count(), *shape)
        else:
            a = np.asarray(array)
            self._shape = a.shape if a.ndim > 1 else (len(a), 1)
            self._rows = _session().createDataFrame([(i, list(map(float, np.ravel(x)))) for i, x in enumerate(a)], "idx long, values array<double>")
        if conditions is not None and len(conditions) != self._shape[-1]:
            raise ValueError("a condition for each of the last dimension is needed")
        self.conditions = conditions

    @property
    def shape(self) -> tuple[int, ...]:
        return self._shape

    def rows(self) -> DataFrame:
        return self._rows


class Wrapper(Dataset):
    """A dataset seen through an operation."""

    def __init__(self, data: Dataset):
        self.data, self.name = data, data.name

    @property
    def conditions(self):
        return self.data.conditions

    @property
    def gindexer(self):
        return self.data.gindexer

    @property
    def shape(self):
        return self.data.shape

    def rows(self) -> DataFrame:
        return self.data.rows()

    def map(self, f) -> DataFrame:
        return self.data.rows().withColumn("values", f(F.col("values")))


class ReduceDim(Wrapper):
    def __init__(self, data: Dataset, aggregator=None, axis=None):
        super().__init__(data)
        self.aggregator, self.axis = aggregator, (1, 2) if axis is None else (axis,) if isinstance(axis, int) else tuple(axis)
        if not callable(aggregator) and aggregator not in (None, "sum", "mean", "max"):
            raise ValueError(f"unknown aggregator {aggregator}")

    @property
    def shape(self):
        return tuple(n for i, n in enumerate(self.data.shape) if i not in self.axis)

    def rows(self) -> DataFrame:
        cells = tensor.reduce_dim(tensor.unstack(self.data.rows(), self.data.shape[1:]), self.aggregator, self.axis)
        left = [c for i, c in ((1, "pos"), (2, "strand"), (3, "condition")) if i not in self.axis]
        return cells.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct(*left, "value"))), lambda x: x["value"]).alias("values"))


class SqueezeDim(Wrapper):
    def __init__(self, data: Dataset, axis=None):
        super().__init__(data)
        self.axis = axis

    @property
    def shape(self):
        return tensor.squeeze(self.data.shape, self.axis)


class Transpose(Wrapper):
    def __init__(self, data: Dataset, axis):
        super().__init__(data)
        self.axis = tuple(axis)
        if self.axis[0] != 0:
            raise ValueError("the first dimension stays first")

    @property
    def shape(self):
        return tuple(self.data.shape[a] for a in self.axis)

    def rows(self) -> DataFrame:
        return self.map(lambda v: tensor.transpose(v, self.data.shape[1:], tuple(a - 1 for a in self.axis[1:])))


class NanToNumConverter(Wrapper):
    def rows(self) -> DataFrame:
        return self.map(lambda v: F.transform(v, tensor.nan_to_num))


class RandomSignalScale(Wrapper):
    def __init__(self, data: Dataset, deviance: float, seed: int = 0):
        super().__init__(data)
        self.deviance, self.seed = deviance, seed

    def rows(self) -> DataFrame:
        n = self.data.shape[-1]
        factor = lambda i: 1 - self.deviance + 2 * self.deviance * F.pmod(F.xxhash64(F.lit(self.seed), "idx", F.pmod(i, F.lit(n))), F.lit(1 << 30)) / float(1 << 30)
        return self.map(lambda v: F.transform(v, lambda x, i: x * factor(i)))


class RandomOrientation(Wrapper):
    def __init__(self, data: Dataset, seed: int = 0):
        super().__init__(data)
        self.seed = seed

    def rows(self) -> DataFrame:
        return tensor.random_orientation(self.data.rows(), self.data.shape[1:], self.seed)


class RandomShift(Wrapper):
    def __init__(self, data: Dataset, shift: int, batchwise: bool = False, seed: int = 0):
        super().__init__(data)
        self.shift, self.batchwise, self.seed = shift, batchwise, seed

    def rows(self) -> DataFrame:
        return tensor.random_shift(self.data.rows(), self.data.shape[1:], self.shift, self.seed, batchwise=self.batchwise)


class Batches:
    """Mini-batches of inputs, outputs and weights side by side; shuffled anew after each epoch if a seed is given."""

    def __init__(self, inputs, outputs=None, sample_weights=None, batch_size: int = 32, shuffle_seed: int | None = None, as_dict: bool = False):
        listed = lambda x: [] if x is None else list(x.values()) if isinstance(x, dict) else list(x) if isinstance(x, (list, tuple)) else [x]
        self.inputs, self.outputs, self.weights = listed(inputs), listed(outputs), listed(sample_weights)
        self.size, self.seed, self.epoch, self.as_dict = batch_size, shuffle_seed, 0, as_dict
        lengths = {len(d) for d in (*self.inputs, *self.outputs)}
        if len(lengths) > 1:
            raise ValueError(f"datasets differ in length: {sorted(lengths)}")
        self.n = lengths.pop()

    def __len__(self) -> int:
        return -(-self.n // self.size)

    def rows(self) -> DataFrame:
        held = tensor.zipped({f"d{i}": d.rows() for i, d in enumerate((*self.inputs, *self.outputs))})
        return tensor.batches(held, self.size, shuffle_seed=None if self.seed is None or not self.epoch else self.seed + self.epoch)

    def __iter__(self):
        """Streams batches to the driver, a partition at a time."""
        sets, k = (*self.inputs, *self.outputs), len(self.inputs)
        held, batch = [], None

        def made():
            arrays = [np.array([r[f"d{i}"] for r in held], float).reshape((len(held), *d.shape[1:])) for i, d in enumerate(sets)]
            parts = arrays[:k], arrays[k:]
            return tuple(dict(zip((d.name for d in ds), a)) for ds, a in zip((self.inputs, self.outputs), parts)) if self.as_dict else parts

        for r in self.rows().orderBy("batch", "idx").toLocalIterator():
            if batch is not None and r["batch"] != batch:
                yield made()
                held = []
            batch = r["batch"]
            held.append(r)
        if held:
            yield made()
        self.epoch += 1


class VariantStreamer:
    """Variants of a VCF file in the context of a genome."""

    def __init__(self, bioseq: Bioseq | DataFrame | str, variants_: str | DataFrame, binsize: int, batch_size: int = 128, annotation=None, ignore_reference_match: bool = False, order: int | None = None):
        if isinstance(bioseq, Bioseq) and not bioseq.whole_genome:
            raise ValueError("the whole genome must be stored")
        spark = _session()
        self.order = order or (bioseq.order if isinstance(bioseq, Bioseq) else 1)
        self.sequences = bioseq.sequences if isinstance(bioseq, Bioseq) else bioseq if isinstance(bioseq, DataFrame) else read_fasta(spark, bioseq)
        self.variants = variants_ if isinstance(variants_, DataFrame) else read_vcf(spark, variants_)
        self.binsize, self.batch_size, self.ignore = binsize, batch_size, ignore_reference_match
        self.annotation = None if annotation is None else as_intervals(spark, annotation)

    def rows(self) -> DataFrame:
        return variants.stream(self.variants, self.sequences, self.binsize, self.order, self.annotation, self.ignore)

    def count(self) -> int:
        return variants.admissible(self.variants, self.binsize).count()

    def predict(self, model, conditions: list[str]) -> DataFrame:
        return variants.predict_effects(self.rows(), model, conditions, self.batch_size)

    def write(self, model, conditions: list[str], folder: str, condition_filter: str | None = None) -> DataFrame:
        """The effects as tables in a folder; with a filter, of the conditions in whose name its pattern is found."""
        scored = self.predict(model, conditions)
        if condition_filter is not None:
            left_out = [c for c in conditions if not re.search(condition_filter, c)]
            scored = scored.drop(*(f"{a}_{c}" for a in ("ref", "alt", "diff", "logodds") for c in left_out))
        return variants.write_effects(scored, folder)


def input_attribution(inputs: list[Dataset], gradient: Callable, chrom: str, start: int, end: int, steps: int = 50) -> list[DataFrame]:
    """For each input (pos, strand, condition, value): integrated gradients along an interval, where windows overlap the greatest magnitude.

    ``gradient``: as in ``tensor.integrated_gradients``. Windows count that meet the interval in all inputs.
    """
    near = [d.gindexer.flanked().where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start)) for d in inputs]
    held = None
    for i, (d, w) in enumerate(zip(inputs, near)):
        one = d.rows().join(w.select("idx"), "idx", "left_semi").select("idx", F.col("values").alias(f"d{i}"))
        held = one if held is None else held.join(one, "idx")
    scored = tensor.integrated_gradients(held, gradient, [f"d{i}" for i in range(len(inputs))], steps)
    out = []
    for i, (d, w) in enumerate(zip(inputs, near)):
        size = getattr(d, "resolution", 1) or 1
        cells = tensor.unstack(scored.select("idx", F.col(f"d{i}").alias("values")), d.shape[1:]).join(w.select("idx", F.col("start").alias("_w")), "idx")
        first = F.col("_w") + F.col("pos") * size
        cells = cells.select(F.explode(F.sequence(first, first + (size - 1))).alias("at"), "strand", "condition", "value")
        cells = cells.where((F.col("at") >= start) & (F.col("at") < end))
        out.append(tensor.max_abs(cells.withColumnRenamed("at", "pos"), ["pos", "strand", "condition"]))
    return out


def view(data: Dataset, regions) -> Dataset:
    return data.view(regions)


def subset(data: Dataset, include=None, exclude=None) -> Dataset:
    return data.subset(include=include, exclude=exclude)


split_train_test = access.split_train_test
