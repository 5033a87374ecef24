"""Packed exchanges: joins of word windows without a row for each window.

A corpus is dealt into buckets of whole documents by a hash of their id and text. A bucket sums up its windows as sorted
distinct hashes, and sends each part of the hash space its own range as one compressed binary value. A part sees
all windows of its range, whichever bucket they come from, and answers each bucket with the hashes that matter to
it. As each bucket sends a hash once, a window that a third of all documents share costs a row no more than any
other: there are no hot keys. Buckets and parts are as many as the session's shuffle partitions, which sizes both
to the input; what a task holds is one bucket's words or one part's hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Stands for a null id: greater than any other.
NO_ID = (1 << 63) - 1


@lru_cache(1)
def _zstd() -> pa.Codec:
    return pa.Codec("zstd", 1)


def press(data: bytes) -> bytes:
    return _zstd().compress(data, asbytes=True)


def release(data: bytes, size: int) -> bytes:
    return _zstd().decompress(data, size, asbytes=True) if size else b""


def squeeze(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as byte planes, compressed. Sorted arrays are best given as their differences."""
    parts = [np.array([len(arrays)], "<u8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        parts += [np.array([len(a), width], "<u8").tobytes(), a.view(np.uint8).reshape(-1, 8).T[:width].tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + press(raw)


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = release(blob[8:], int.from_bytes(blob[:8], "little"))
    at, out = 8, []
    for _ in range(int.from_bytes(raw[:8], "little")):
        n, width = (int(x) for x in np.frombuffer(raw, "<u8", 2, at))
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(a.view("<u8").reshape(-1))
        at += 16 + n * width
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; ``np.cumsum`` undoes it."""
    return np.diff(a, prepend=np.uint64(0))


def places(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of ``h`` is, or would be, in sorted ``known``: looked up in order, which memory likes better."""
    order = np.argsort(h)
    out = np.empty(len(h), np.int64)
    out[order] = np.searchsorted(known, h[order])
    return out


class Parts:
    """``count`` ranges of the 64-bit hash space. Hashes keep ``bits`` bits within their range."""

    def __init__(self, count: int, bits: int = 64):
        self.count = count
        self.low = (np.array([-(-(p << 32) // count) for p in range(count)], np.uint64)) << np.uint64(32)
        self.shift = np.uint64(max(0, 64 - (count.bit_length() - 1) - bits))

    def of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.count)) >> np.uint64(32)

    def cut(self, h: np.ndarray) -> np.ndarray:
        """Hashes as they are after ``whole``."""
        low = self.low[self.of(h).astype(np.int64)]
        return (((h - low) >> self.shift) << self.shift) + low

    def split(self, h: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(part, where it lies) of sorted hashes."""
        ends = np.searchsorted(h, self.low)
        for p, (s, e) in enumerate(zip(ends, np.r_[ends[1:], len(h)])):
            if e > s:
                yield p, slice(int(s), int(e))

    def short(self, p: int, h: np.ndarray) -> np.ndarray:
        return (h - self.low[p]) >> self.shift

    def whole(self, p: int, r: np.ndarray) -> np.ndarray:
        return (r << self.shift) + self.low[p]


def dealt(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, blob): documents by a hash of their integer id and text, many to a compressed value."""

    def run(batches):
        for b in batches:
            bucket = b.column(2).to_numpy()
            order = np.argsort(bucket, kind="stable")
            held = pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.large_string())], ["id", "text"]).take(pa.array(order))
            bucket = bucket[order]
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
            names, blobs = [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e > s:
                    names.append(int(bucket[s]))
                    part = held.slice(s, e - s)
                    text = part.column(1)
                    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                    data = bytes(memoryview(text.buffers()[2])[offsets[0] : offsets[-1]]) if text.buffers()[2] else b""
                    ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    head = squeeze(ids.view(np.uint64), np.diff(offsets).astype(np.uint64))
                    blobs.append(len(head).to_bytes(8, "little") + len(data).to_bytes(8, "little") + head + press(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    ship(docs.sparkSession)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(ident.alias("id"), text.alias("text"), F.pmod(F.xxhash64(ident, text), F.lit(buckets)).cast("int").alias("bucket")).mapInArrow(run, "bucket int, blob binary")


def documents(held: pa.Table, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(ids, texts) of a bucket, in pieces of about ``most`` bytes, always the same ones."""
    ids, sizes, data, total = [], [], [], 0
    for blob in sorted(x.as_py() for x in held.column("blob")):
        h, n = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
        a, b = unsqueeze(blob[16 : 16 + h])
        ids.append(a.view(np.int64))
        sizes.append(b)
        data.append(release(blob[16 + h :], n))
        total += n
        if total >= most:
            yield _texts(ids, sizes, data)
            ids, sizes, data, total = [], [], [], 0
    if ids:
        yield _texts(ids, sizes, data)


def _texts(ids, sizes, data) -> tuple[np.ndarray, pa.Array]:
    size = np.concatenate(sizes)
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    return np.concatenate(ids), pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(b"".join(data)))


PACKED = "part int, bucket int, blob binary"


def packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    part, bucket, blob = zip(*rows) if rows else ((), (), ())
    return pa.table({"part": pa.array(part, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})


def send(dealt_docs: DataFrame, f: Callable[[int, pa.Table], list[tuple[int, int, bytes]]]) -> DataFrame:
    """``f(bucket, documents)`` gives rows for parts."""
    return dealt_docs.groupBy("bucket").applyInArrow(lambda t: packed(f(t.column("bucket")[0].as_py(), t)), PACKED)


def meet(sent: DataFrame, f: Callable[[int, list[int], list[bytes]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """``f(part, buckets, blobs)`` gives rows for buckets."""
    return sent.groupBy("part").applyInArrow(lambda t: packed(f(t.column("part")[0].as_py(), t.column("bucket").to_pylist(), t.column("blob").to_pylist())), PACKED)


def back(dealt_docs: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """``f(bucket, documents, [(part, blob), ...])``, parts in order, for each bucket of documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(zip(right.column("part").to_pylist(), right.column("blob").to_pylist()))
        return f(left.column("bucket")[0].as_py(), left, got)

    return dealt_docs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)
