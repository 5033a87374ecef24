"""BIGWIG signal: a reader of its index and data blocks, a data source that splits files by blocks, and a writer."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship
from .ranged import by_ranges, load, located, open_at, options

SCHEMA = "chrom string, start long, end long, value double"
FILE_SCHEMA = SCHEMA + ", file string"
MAGIC, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BLOCKS = 2000


def header(f) -> tuple[dict[int, tuple[str, int]], int, bool]:
    """({chrom id: (name, length)}, offset of the index, whether blocks are compressed)."""
    f.seek(0)
    magic, _, _, tree, _, index, _, _, _, _, packed, _ = struct.unpack("<IHHQQQHHQQIQ", f.read(64))
    if magic != MAGIC:
        raise ValueError("not a BIGWIG file")
    f.seek(tree)
    _, _, key, _, _, _ = struct.unpack("<IIIIQQ", f.read(32))
    return dict(_leaves(f, tree + 32, key)), index, packed > 0


def _leaves(f, at: int, key: int) -> Iterator[tuple[int, tuple[str, int]]]:
    f.seek(at)
    leaf, _, n = struct.unpack("<BBH", f.read(4))
    rows = [f.read(key + 8) for _ in range(n)]
    for r in rows:
        if leaf:
            ident, length = struct.unpack("<II", r[key:])
            yield ident, (r[:key].rstrip(b"\0").decode(), length)
        else:
            yield from _leaves(f, struct.unpack("<Q", r[key:])[0], key)


def data_blocks(f, index: int, near: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks, in order: of all, or of those that meet (chrom id, start, end) regions.

    Branches of the index that no region meets aren't followed.
    """
    out, nodes = [], [index + 48]
    apart: list[tuple[int, int, int]] = []
    for c, s, e in sorted(near or []):
        if apart and apart[-1][0] == c and s <= apart[-1][2]:
            apart[-1] = (c, apart[-1][1], max(e, apart[-1][2]))
        else:
            apart.append((c, s, e))
    ends = [(c, e) for c, _, e in apart]

    def met(low: tuple[int, int], high: tuple[int, int]) -> bool:
        i = bisect_right(ends, low)  # the first region that ends behind
        return near is None or i < len(ends) and apart[i][:2] < high

    while nodes:
        f.seek(nodes.pop())
        leaf, _, n = struct.unpack("<BBH", f.read(4))
        rows = [f.read(32 if leaf else 24) for _ in range(n)]
        for r in rows:
            first, start, last, end = struct.unpack("<IIII", r[:16])
            if met((first, start), (last, end)):
                if leaf:
                    out.append(struct.unpack("<QQ", r[16:]))
                else:
                    nodes.append(struct.unpack("<Q", r[16:])[0])
    return sorted(out)


def block_arrays(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(chrom id, starts, ends, values) of one data block, of any of its three kinds."""
    ident, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", data)
    fields = {1: [("s", "<u4"), ("e", "<u4"), ("v", "<f4")], 2: [("s", "<u4"), ("v", "<f4")], 3: [("v", "<f4")]}[kind]
    rows = np.frombuffer(data, np.dtype(fields), n, 24)
    starts = rows["s"].astype(np.int64) if kind < 3 else start + step * np.arange(n, dtype=np.int64)
    return ident, starts, rows["e"].astype(np.int64) if kind == 1 else starts + span, rows["v"].astype(np.float64)


def block_runs(data: bytes, chroms: dict[int, tuple[str, int]]) -> Iterator[tuple[str, int, int, float]]:
    """The runs of one data block."""
    ident, *arrays = block_arrays(data)
    return ((chroms[ident][0], *r) for r in zip(*(a.tolist() for a in arrays)))


def block_parts(f, some: list[tuple[int, int]] | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(chrom, starts, ends, values) of each data block."""
    chroms, index, packed = header(f)
    for at, size in some if some is not None else data_blocks(f, index):
        f.seek(at)
        raw = f.read(size)
        ident, *arrays = block_arrays(zlib.decompress(raw) if packed else raw)
        yield chroms[ident][0], *arrays


class _Part(InputPartition):
    def __init__(self, path: str, some: list[tuple[int, int]]):
        self.path, self.some = path, some


class BigWigReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], size: int, regions: list[tuple[str, int, int]] | None = None):
        self.files, self.size, self.regions = files, size, regions

    def partitions(self):
        out = []
        for path, _ in self.files:
            with open_at(path) as f:
                chroms, index, _ = header(f)
                ids = {name: i for i, (name, _) in chroms.items()}
                near = None if self.regions is None else [(ids[c], s, e) for c, s, e in self.regions if c in ids]
                held = data_blocks(f, index, near)
            out += [_Part(path, held[i : i + self.size]) for i in range(0, len(held), self.size)]
        return out or [_Part("", [])]

    def read(self, partition):
        import pyarrow as pa

        if not partition.some:
            return
        with open_at(partition.path) as f:
            for name, *arrays in block_parts(f, partition.some):
                n = len(arrays[0])
                columns = [pa.array([name] * n, pa.string()), *map(pa.array, arrays), pa.array([partition.path] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["chrom", "start", "end", "value", "file"])


class BigWigDataSource(DataSource):
    """Options: blocks (data blocks a task)."""

    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return FILE_SCHEMA

    def reader(self, schema):
        files, regions = options(self.options)
        return BigWigReader(files, int(self.options.get("blocks", BLOCKS)), regions)


def read_bigwig(spark: SparkSession, path: str | list[str], nan_to_num: bool = True, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Runs of BIGWIG files, with their file; NaN becomes 0 unless told otherwise.

    Files are read by data blocks, of which those that meet no region are left out; in a store that neither Python nor
    pyarrow opens, each file is one value in one task (2 GB at most).
    """

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                for chrom, starts, ends, values in block_parts(io.BytesIO(content)):
                    yield pd.DataFrame({"chrom": chrom, "start": starts, "end": ends, "value": values, "file": name})

    files = located(spark, path)
    if by_ranges(files):
        out = load(spark, BigWigDataSource, files, regions)
    else:
        ship(spark)
        out = spark.read.format("binaryFile").load([p for p, _ in files]).select("path", "content").mapInPandas(run, FILE_SCHEMA)
    return out.withColumn("value", F.when(F.isnan("value"), 0.0).otherwise(F.col("value"))) if nan_to_num else out


def bigwig_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, length, ord) of the files' headers."""
    files = located(spark, path)
    if by_ranges(files):
        held = []
        for p, _ in files:
            with open_at(p) as f:
                held += [(c, n, i) for i, (c, n) in sorted(header(f)[0].items())]
        rows = spark.createDataFrame(held, "chrom string, length long, ord long")  # a row a chromosome and file
        return rows.groupBy("chrom").agg(F.max("length").alias("length"), F.min("ord").alias("ord"))

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame([(c, n, i) for i, (c, n) in sorted(header(io.BytesIO(content))[0].items())], columns=["chrom", "length", "ord"])

    ship(spark)
    rows = spark.read.format("binaryFile").load([p for p, _ in files]).select("content").mapInPandas(run, "chrom string, length long, ord long")
    return rows.groupBy("chrom").agg(F.max("length").alias("length"), F.min("ord").alias("ord"))


def write_bigwig(f, sizes: list[tuple[str, int]], rows: Iterable[tuple[str, int, int, float]], items: int = 1024) -> None:
    """Writes runs in order of chromosome name and start; an index of as many levels as it takes, no zoom levels. Only the index is held."""
    chroms = sorted(sizes)
    ids = {c: i for i, (c, _) in enumerate(chroms)}
    key = max((len(c) for c, _ in chroms), default=1)
    tree = struct.pack("<IIIIQQ", TREE, max(1, len(chroms)), key, 8, len(chroms), 0) + struct.pack("<BBH", 1, 0, len(chroms))
    tree += b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", ids[c], n) for c, n in chroms)
    data_at = 64 + len(tree)
    f.write(b"\0" * 64 + tree + b"\0" * 8)
    held, index, at = [], [], data_at + 8

    def flush():
        nonlocal held, at
        if held:
            c, s, e = ids[held[0][0]], held[0][1], held[-1][2]
            raw = struct.pack("<IIIIIBBH", c, s, e, 0, 0, 1, 0, len(held)) + b"".join(struct.pack("<IIf", *r[1:]) for r in held)
            packed = zlib.compress(raw)
            f.write(packed)
            index.append((c, s, e, at, len(packed)))
            held, at = [], at + len(packed)

    for r in rows:
        if held and (held[0][0] != r[0] or len(held) == items):
            flush()
        held.append(r)
    flush()
    per = 512
    # each level is a list of nodes, and each node a list of (first chrom, start, last chrom, end, place and size or node)
    span = lambda g: (g[0][0], g[0][1], g[-1][2], max((x[3] for x in g if x[2] == g[-1][2]), default=0)) if g else (0, 0, 0, 0)
    cut = lambda x: [x[i : i + per] for i in range(0, len(x), per)]
    levels = [cut([(c, s, c, e, a, n) for c, s, e, a, n in index]) or [[]]]
    while len(levels[-1]) > 1:
        levels.append(cut([span(g) for g in levels[-1]]))
    f.write(struct.pack("<IIQIIIIQII", INDEX, per, len(index), *span(levels[-1][0]), at, items, 0))
    place = at + 48
    for i in range(len(levels) - 1, 0, -1):
        below = iter(levels[i - 1])
        place += sum(4 + 24 * len(g) for g in levels[i])
        child = place
        for g in levels[i]:
            f.write(struct.pack("<BBH", 0, 0, len(g)))
            for x in g:
                f.write(struct.pack("<IIIIQ", *x, child))
                child += 4 + (32 if i == 1 else 24) * len(next(below))
    for g in levels[0]:
        f.write(struct.pack("<BBH", 1, 0, len(g)) + b"".join(struct.pack("<IIIIQQ", *x) for x in g))
    f.seek(0)
    f.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, 64, data_at, at, 0, 0, 0, 0, 1 << 15, 0))
    f.seek(data_at)
    f.write(struct.pack("<Q", len(index)))
