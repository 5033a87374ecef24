"""BAM alignments: a reader of the BGZF container and its records, and a data source that splits files.

``read_bam`` reads files by ranges of bytes wherever Python or pyarrow can open them, and near regions only where an
index (.bai) lies beside a file; in other stores each file is one value in one task (2 GB at most).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship
from .ranged import arrow_batches, by_ranges, exists, load, located, open_at, options

SCHEMA = "chrom string, reference_start long, reference_end long, is_reverse boolean, is_unmapped boolean, mapq int, is_paired boolean, is_proper_pair boolean, is_read2 boolean, next_chrom string, next_reference_start long, template_length long, query_length long, name string"
FILE_SCHEMA = SCHEMA + ", file string"
_FIXED = struct.Struct("<iiBBHHHiiii")
#: CIGAR operations that use up the reference: M D N = X.
_ON_REFERENCE = {0, 2, 3, 7, 8}
SPLIT = 32 << 20


def block_size(head: bytes) -> int:
    """The length of the BGZF block whose first 18 bytes these are."""
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a BGZF block")
    return struct.unpack("<H", head[16:18])[0] + 1


def blocks(f, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the blocks from an offset on."""
    f.seek(start)
    while head := f.read(18):
        size = block_size(head)
        raw = head + f.read(size - 18)
        yield start, zlib.decompress(raw[18:-8], -15)
        start += size


def header(f) -> tuple[list[tuple[str, int]], int, int]:
    """([(name, length)], offset of the block where records start, place in it)."""
    data, ends = b"", []
    for at, part in blocks(f):
        ends.append((at, len(data)))
        data += part
        try:
            text = struct.unpack_from("<i", data, 4)[0]
            p = 8 + text
            n = struct.unpack_from("<i", data, p)[0]
            p, refs = p + 4, []
            for _ in range(n):
                size = struct.unpack_from("<i", data, p)[0]
                name = data[p + 4 : p + 4 + size - 1].decode()
                length = struct.unpack_from("<i", data, p + 4 + size)[0]
                refs.append((name, length))
                p += 8 + size
            if p > len(data):
                continue
            block, base = next((a, b) for a, b in reversed(ends) if b <= p)
            return refs, block, p - base
        except struct.error:
            continue
    raise ValueError("no BAM header")


def record(data: bytes, at: int, refs: list[tuple[str, int]]) -> tuple:
    """The row of the record whose length field is at ``at``."""
    ref, pos, name_n, mapq, _, cigar_n, flag, seq_n, next_ref, next_pos, tlen = _FIXED.unpack_from(data, at + 4)
    p = at + 4 + _FIXED.size
    name = data[p : p + name_n - 1].decode()
    cigar = struct.unpack_from(f"<{cigar_n}I", data, p + name_n)
    span = sum(c >> 4 for c in cigar if c & 15 in _ON_REFERENCE)
    chrom = lambda i: refs[i][0] if i >= 0 else None
    return (chrom(ref), pos, pos + span if cigar_n else None, bool(flag & 16), bool(flag & 4), mapq, bool(flag & 1), bool(flag & 2), bool(flag & 128), chrom(next_ref), next_pos, tlen, seq_n, name)


def plausible(data: bytes, at: int, refs: list[tuple[str, int]], chain: int = 3) -> bool:
    """Whether records may start at a place: sane fields for several records in a row, or up to the data's end."""
    for _ in range(chain):
        if at + 36 > len(data):
            return at <= len(data) and _ > 0
        size, ref, pos, name_n, _mq, _b, cigar_n, _f, seq_n, next_ref, next_pos, _t = struct.unpack_from("<iiiBBHHHiiii", data, at)
        if not (-1 <= ref < len(refs) and -1 <= next_ref < len(refs) and seq_n >= 0 and name_n > 0 and pos >= -1 and next_pos >= -1):
            return False
        if ref >= 0 and pos > refs[ref][1] or size < 32 + name_n + 4 * cigar_n + (seq_n + 1) // 2 + seq_n:
            return False
        end = at + 36 + name_n - 1
        if end < len(data) and data[end] != 0:
            return False
        at += 4 + size
    return True


def records(f, refs, block: int, place: int | None, stop: int | None) -> Iterator[tuple]:
    """Rows of the records that start in the blocks [block, stop); without a place, from the first plausible one."""
    data, base, parts = b"", 0, blocks(f, block)
    starts: list[tuple[int, int]] = []  # (offset of a block, where its data begins)
    at = place
    total = 0
    for offset, part in parts:
        starts.append((offset, total))
        data, total = data + part, total + len(part)
        if at is None:
            at = next((i for i in range(min(len(data), 1 << 17)) if plausible(data, i, refs)), None)
            if at is None:
                if stop is not None and offset >= stop:
                    return
                continue
        while at - base + 4 <= len(data):
            size = struct.unpack_from("<i", data, at - base)[0]
            if at - base + 4 + size > len(data):
                break
            while len(starts) > 1 and starts[1][1] <= at:
                starts.pop(0)
            if stop is not None and starts[0][0] >= stop:
                return
            yield record(data, at - base, refs)
            at += 4 + size
        data, base = data[at - base :], at
        while len(starts) > 1 and starts[1][1] <= at:
            starts.pop(0)
        if stop is not None and starts[0][0] >= stop:
            return


def first_block(f, at: int, stop: int) -> int | None:
    """The offset of the first block that begins in the bytes [at, stop): a block's head that another one, or the end, follows."""
    f.seek(0, 2)
    total = f.tell()
    while at < stop:
        f.seek(at)
        data = f.read(min(stop - at, 1 << 16) + 3)
        p = data.find(b"\x1f\x8b\x08\x04")
        if p < 0:
            at += max(1, len(data) - 3)
            continue
        at += p
        f.seek(at)
        head = f.read(18)
        if at < stop and len(head) == 18 and head[12:16] == b"BC\x02\0":
            after = at + block_size(head)
            f.seek(after)
            if after == total or f.read(4) == b"\x1f\x8b\x08\x04":
                return at
        at += 1
    return None


def _bins(start: int, end: int) -> set[int]:
    """The index's bins that may hold alignments of [start, end): spans of 2^29 down to 2^14 places."""
    out = {0}
    for level, shift in enumerate((26, 23, 20, 17, 14), 1):
        first = ((1 << 3 * level) - 1) // 7
        out.update(range(first + (start >> shift), first + ((end - 1) >> shift) + 1))
    return out


def index_chunks(data: bytes, refs: list[tuple[str, int]], regions: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(block, place in it, stop) ranges of blocks, apart, that hold all alignments of regions, by a .bai index."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    wanted = {}
    for chrom, start, end in regions:
        wanted.setdefault(chrom, []).append((start, min(end, 1 << 29)))
    at, found = 8, []
    for chrom, _ in refs[: struct.unpack_from("<i", data, 4)[0]]:
        n = struct.unpack_from("<i", data, at)[0]
        at, bins = at + 4, {}
        for _ in range(n):
            ident, count = struct.unpack_from("<Ii", data, at)
            bins[ident] = [struct.unpack_from("<QQ", data, at + 8 + 16 * i) for i in range(count)]
            at += 8 + 16 * count
        n = struct.unpack_from("<i", data, at)[0]
        linear = struct.unpack_from(f"<{n}Q", data, at + 4)
        at += 4 + 8 * n
        for start, end in wanted.get(chrom, []):
            if start >= end:
                continue
            least = linear[start >> 14] if start >> 14 < n else 0
            found += [c for b in _bins(start, end) & bins.keys() for c in bins[b] if c[1] > least]
    out: list[tuple[int, int, int]] = []
    for begin, end in sorted(found):
        block, stop = begin >> 16, (end >> 16) + (1 if end & 0xFFFF else 0)
        if out and block < out[-1][2]:
            out[-1] = (*out[-1][:2], max(out[-1][2], stop))
        elif out and block == out[-1][2]:
            out[-1] = (*out[-1][:2], max(stop, block + 1))
        else:
            out.append((block, begin & 0xFFFF, max(stop, block + 1)))
    return out


class _Split(InputPartition):
    def __init__(self, path: str, start: int, place: int | None, stop: int):
        self.path, self.start, self.place, self.stop = path, start, place, stop


class BamReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], size: int, regions: list[tuple[str, int, int]] | None = None):
        self.files, self.size, self.regions = files, size, regions

    def partitions(self):
        """Ranges of bytes: a task reads the records that start in the blocks that begin in its range."""
        out = []
        for path, total in self.files:
            index = next((p for p in (path + ".bai", path.removesuffix(".bam") + ".bai") if self.regions is not None and exists(p)), None)
            if index is None:
                out += [_Split(path, at, None, min(at + self.size, total)) for at in range(0, total, self.size)]
                continue
            with open_at(path) as f, open_at(index) as i:
                held = index_chunks(i.read(), header(f)[0], self.regions)
            for block, place, stop in held:
                cuts = list(range(block + self.size, stop, self.size))
                out += [_Split(path, b, place if b == block else None, e) for b, e in zip([block, *cuts], [*cuts, stop])]
        return out or [_Split("", 0, None, 0)]

    def rows(self, split) -> Iterator[tuple]:
        if not split.path:
            return
        with open_at(split.path) as f:
            start, place = split.start, split.place
            if place is None:
                start = first_block(f, start, split.stop)
                if start is None:
                    return
            refs, first, begins = header(f)
            if start <= first:  # records begin behind the header
                if split.stop <= first:
                    return
                start, place = (first, begins) if split.place is None else (start, place)
            for r in records(f, refs, start, place, split.stop):
                yield (*r, split.path)

    def read(self, partition):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in FILE_SCHEMA.split(", "))])
        return arrow_batches(self.rows(partition), schema)


class BamDataSource(DataSource):
    """Options: split (bytes of compressed data a task)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return FILE_SCHEMA

    def reader(self, schema):
        files, regions = options(self.options)
        return BamReader(files, int(self.options.get("split", SPLIT)), regions)


def _decode(batches):
    import io

    import pandas as pd

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            f = io.BytesIO(content)
            refs, block, place = header(f)
            held = []
            for r in records(f, refs, block, place, None):
                held.append(r)
                if len(held) == 20_000:
                    yield pd.DataFrame(held, columns=names).assign(file=path)
                    held = []
            yield pd.DataFrame(held, columns=names).assign(file=path)


def read_bam(spark: SparkSession, path: str | list[str], regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Reads of BAM files with their file; where there is an index, only blocks that hold reads of ``regions`` are read."""
    files = located(spark, path)
    if by_ranges(files):
        return load(spark, BamDataSource, files, regions)
    ship(spark)
    return spark.read.format("binaryFile").load([p for p, _ in files]).select("path", "content").mapInPandas(_decode, FILE_SCHEMA)


def bam_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, length, ord) of the files' headers."""
    files = located(spark, path)
    schema = "chrom string, length long, ord long"
    if by_ranges(files):
        held = []
        for p, _ in files:
            with open_at(p) as f:
                held += [(c, n, i) for i, (c, n) in enumerate(header(f)[0])]
        rows = spark.createDataFrame(held, schema)  # a row a chromosome and file
        return rows.groupBy("chrom").agg(F.max("length").alias("length"), F.min("ord").alias("ord"))

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                refs, _, _ = header(io.BytesIO(content))
                yield pd.DataFrame([(c, n, i) for i, (c, n) in enumerate(refs)], columns=["chrom", "length", "ord"])

    ship(spark)
    rows = spark.read.format("binaryFile").load([p for p, _ in files]).select("content").mapInPandas(run, schema)
    return rows.groupBy("chrom").agg(F.max("length").alias("length"), F.min("ord").alias("ord"))
