"""What the corpus operators share: shared-folder checkpoints, and word tables over Arrow buffers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..schema import spread
from ..shipping import ship as ship

#: The word separators of every operator here: space, tab, newline, vertical tab, form feed, return.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to all cores where its files have fewer parts than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the one knob that sizes buckets to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on a local master, where it may be unset, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_WORDS = np.ones(256, np.uint8)
_WORDS[list(SPACES)] = 0
#: Words longer than this are hashed by SHA-256.
_LONG = 1 << 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of many texts, without a Python object for each.

    With ``classes`` (of all bytes; 0 is between words), words also end where the class changes.

    ``row`` (of each word's text), ``at`` (its number in that text), ``start`` and ``end`` (bytes in
    ``data``), ``hash`` (64 bits of the word's bytes), ``first`` (each text's first word; one more at the end).
    """

    def __init__(self, texts: pa.Array, classes: np.ndarray | None = None):
        texts = texts.fill_null("") if texts.null_count else texts
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data, self.offsets = data, offsets
        kind = np.zeros(len(data) + 2, np.uint8)
        kind[1:-1] = (_WORDS if classes is None else classes)[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        change = kind[1:] != kind[:-1]
        change |= cut
        word = kind[1:-1] > 0
        self.start = np.flatnonzero(word & change[:-1])
        self.end = np.flatnonzero(word & change[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), count)
        self.at = np.arange(len(self.start), dtype=np.int64) - np.repeat(self.first[:-1], count)
        self.count = count
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Words by eight bytes at a time, each mixed into all bits of what stands before."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        left, at = self.end - self.start, self.start
        out, which = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(len(at))
        for i in np.flatnonzero(left > _LONG):
            out[i] = np.uint64(int.from_bytes(hashlib.sha256(self.data[self.start[i] : self.end[i]].tobytes()).digest()[:8], "big"))
        usual = left <= _LONG
        if not usual.all():
            which, at, left = which[usual], at[usual], left[usual]
        while len(which):
            out[which] = mix((out[which] ^ (eight[at] & _MASKS[np.minimum(left, 8)])) + np.uint64(0xD6E8FEB86659FD93))
            more = left > 8
            which, at, left = which[more], at[more] + 8, left[more] - 8
        return out

    def rolling(self, n: int, seed: int, factor: int = 0xA0761D6478BD642F) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in all words) where windows of ``n`` words of one text start, and their hashes."""
        total = len(self.hash) - n + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        multiplier, h = np.uint64(factor), np.full(total, seed, np.uint64)
        for j in range(n):
            h *= multiplier
            h += self.hash[j : j + total]
        at = np.flatnonzero(self.row[:total] == self.row[n - 1 : n - 1 + total])
        return at, mix(h[at])

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def loose(kind: pa.DataType) -> pa.DataType:
    """``kind`` with fields that may be null, as Spark declares what comes back from Python."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, loose(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(loose(kind.value_type))
    return kind


def spans(texts: pa.Array, most: int = 1 << 24):
    """Consecutive slices of at most ``most`` bytes each (a longer text stands alone)."""
    lengths = np.cumsum([0, *(x or 0 for x in pc.binary_length(texts).to_pylist())])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(lengths, lengths[i] + most, "right")) - 1)
        yield i, j
        i = j
