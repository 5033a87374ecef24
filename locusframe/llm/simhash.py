"""SimHash near-duplicate detection with pigeonring filtering.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles, 64 bits for each of ``words``
seeds. Two texts are linked if their fingerprints differ in at most ``max_distance`` bits and, where a ``similarity`` is
asked for, if the Jaccard similarity of their shingle sets reaches it. A document's class is the connected component.

Pigeonring: cut the bits into m segments on a ring. If two fingerprints differ in at most t bits, some segment
starts a chain in which, for every length l up to m, the first l segments differ in at most floor(l*t/m) bits. With
m = t + 1 these budgets are 0, 1, 2, ... t. The first two steps of a chain (an equal segment, then one with at most one
differing bit) are an equality join on keys that mask each bit of the second segment in turn; the longer prefixes prune
the pairs one after the other, and the last prefix is the whole Hamming distance. With m <= t, whose segments are wider,
the same keys are taken: links that have no equal segment before one of at most one differing bit are then lost, so
``m`` sets recall against keys' selectivity (README: measured recall of the pipeline's setting).

Only distinct fingerprints take part, so exact copies cost one row. A run of fingerprints with one key gives a forest
of least links that connects whatever its links connect, never all pairs; long runs are dealt out in blocks of bounded
size.

Where a ``similarity`` is asked for, the forest only proposes links, which are compared as texts. What it leaves out
(links beside those taken, of lost segments, beyond the distance) is found exactly: in one order of all shingles, two sets
of that similarity share one of their first n - ceil(similarity * n) + 1 ones (prefix filter), and enough must follow the
first they share (positional filter). Texts of different classes that meet so are brought together, each company once, and
compared where they meet, by sketches whose distance is never over that of the sets, then those that stay by their texts, as a run or as pairs of its blocks: no table of pairs is made, which would grow with the
square of a group of texts just below the similarity; only links that join classes come out. So classes are those of all
pairs of texts that reach the similarity. Shingles frequent in a sample come last in the order, which only spares
comparisons; there is no cap on how many texts share one.

Edge cases: null and blank texts have fingerprint 0 and link like any other; texts of fewer words than a shingle are one
shingle; rows that repeat a doc_id get their own texts' classes; rows with a null doc_id take part in linking but never
name a class in ``near_duplicates``, and stay in ``deduplicate`` if no row of their class has an id; columns that clash
with names used here are carried untouched.
"""

from __future__ import annotations

import gc
import time
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix, partitions, ship

#: Fingerprints of one key that are compared at once; longer runs are dealt out as pairs of blocks.
BLOCK = 4096
#: Runs up to this length are compared all at once; longer ones fingerprint by fingerprint.
SHORT = 256
#: Shingles of texts that are compared at once, but for a single larger text.
SHINGLES = 1 << 19
#: Texts from which the frequent shingles are learnt.
SAMPLE = 20_000
_FP = ">u8"


def simhash(text: bytes, shingle: int = 4, words: int = 1, distinct: bool = False, seed: int = 42) -> bytes:
    """The fingerprint of a text's lower-cased (A-Z) words, 8 bytes for each of ``words`` seeds; 0 where there is no word.

    ``distinct``: each shingle votes once.
    """
    grams = _grams(text, shingle)
    if grams == [b""]:
        return bytes(8 * words)
    grams = set(grams) if distinct else grams
    return b"".join(_majority(_hashes(grams, s)) for s in range(seed, seed + words))


def _grams(text: bytes, shingle: int) -> list[bytes]:
    cut = text.lower().split()
    return list(map(b" ".join, zip(*(cut[i:] for i in range(shingle))))) if len(cut) >= shingle else [b" ".join(cut)]


def _hashes(grams, seed: int) -> np.ndarray:
    """Bytes of the XXH64 hashes."""
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(partial(xxh64_digest, seed=seed), grams)), np.uint8)


def _majority(hashes: np.ndarray) -> bytes:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 19):
        votes += np.unpackbits(hashes[i : i + (1 << 19)]).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes) // 8).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, digest, fp): the MD5 of its text and the fingerprint of each row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [simhash(t.as_buffer().to_pybytes(), shingle, words, distinct) for t in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], ["id", "digest", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text")).mapInArrow(run, f"id {kind}, digest string, fp binary")


def _array(fps: pa.Array, words: int) -> np.ndarray:
    """(n, words) of big-endian fingerprints, the highest bits first."""
    return np.frombuffer(b"".join(fps.to_pylist()), _FP).astype(np.uint64).reshape(-1, words)


def _binary(f: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(f.astype(_FP))
    offsets = np.arange(len(f) + 1, dtype=np.int32) * (8 * f.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Ring:
    """``m`` segments of 64 * ``words`` bits, and the budgets of chains for a distance of ``most``."""

    def __init__(self, words: int, most: int, m: int | None = None):
        self.words, self.most, self.m = words, most, m or most + 1
        bits, at, self.segments = 64 * words, 64 * words, []
        for i in range(self.m):
            width = bits // self.m + (i < bits % self.m)
            at -= width
            self.segments.append((at, width))
        # masks[start, l - 1]: the first l segments of the chain from start
        masks = [[sum(((1 << w) - 1) << a for a, w in (self.segments[(s + j) % self.m] for j in range(n))) for n in range(1, self.m + 1)] for s in range(self.m)]
        self.masks = np.array([[[x >> (64 * (words - 1 - k)) & (1 << 64) - 1 for k in range(words)] for x in row] for row in masks], np.uint64)
        self.budgets = [n * most // self.m for n in range(1, self.m + 1)]

    def part(self, f: np.ndarray, i: int) -> np.ndarray:
        shift, width = self.segments[i]
        word, low = self.words - 1 - shift // 64, np.uint64(shift % 64)
        x = f[:, word] >> low
        if shift % 64 + width > 64:
            x = x | f[:, word - 1] << (np.uint64(64) - low)
        return x & np.uint64((1 << width) - 1)

    def keys(self, f: np.ndarray) -> np.ndarray:
        """All keys of each fingerprint: (keys, n)."""
        out = []
        for i in range(self.m):
            j = (i + 1) % self.m
            equal, near, width = self.part(f, i), self.part(f, j), self.segments[j][1]
            for p in range(width):
                masked = near & ~np.uint64(1 << p)
                out.append((((equal << np.uint64(width)) | masked) << np.uint64(16)) | np.uint64(p << 8 | i))
        return np.stack(out)

    def chained(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Numbers of the differences ``x`` whose chain from ``start`` keeps all its budgets, and so the whole distance."""
        alive = np.arange(len(x))
        for n in range(1, self.m):
            if not len(alive):
                break
            gaps = np.bitwise_count(x[alive] & self.masks[start[alive], n]).sum(1, dtype=np.int64)
            alive = alive[gaps <= self.budgets[n]]
        return alive


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the links (i, j) that make a spanning forest of least weight of ``n`` nodes."""
    order = np.lexsort((j, i, weight))
    i, j, comp, chosen = i[order], j[order], np.arange(n), []
    edge = np.arange(len(i))
    while True:
        apart = comp[i[edge]] != comp[j[edge]]
        edge = edge[apart]
        if not len(edge):
            break
        a, b = comp[i[edge]], comp[j[edge]]
        best = np.full(n, len(i), np.int64)
        np.minimum.at(best, a, edge)
        np.minimum.at(best, b, edge)
        at = np.flatnonzero(best < len(i))
        e = best[at]
        other = np.where(comp[i[e]] == at, comp[j[e]], comp[i[e]])
        chosen.append(np.unique(e))
        parent = np.arange(n)
        parent[at] = other
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


def spanning(f: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """A forest of least links (numbers of ``f``), one fingerprint after the other; ``near(x)``: which differences link."""
    n = len(f)
    left, best, source = np.arange(n), np.full(n, 1 << 30), np.zeros(n, np.int64)
    a, b, x = [], [], None
    while len(left):
        k = int(np.argmin(best[left]))
        x = left[k]
        if best[x] < 1 << 30:
            a.append(source[x])
            b.append(x)
        left = np.delete(left, k)
        diff = f[left] ^ f[x]
        hit = near(diff)
        gap = np.bitwise_count(diff[hit]).sum(1, dtype=np.int64)
        to = left[hit]
        closer = gap < best[to]
        best[to[closer]], source[to[closer]] = gap[closer], x
    return np.array(a, np.int64), np.array(b, np.int64)


def _rows(hot: bool, key, block, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    wide = lambda x: pa.array(np.full(n, x, np.int64) if np.isscalar(x) else x)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, hot)), wide(key), wide(block), _binary(a), _binary(b)], ["hot", "key", "block", "a", "b"])


def _linked(ring: Ring, k: np.ndarray, f: np.ndarray):
    """Links within the runs of equal keys."""
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    length = np.diff(np.r_[begin, len(k)])
    for i in np.flatnonzero(length > SHORT):
        g, start = f[begin[i] : begin[i] + length[i]], int(k[begin[i]]) & 255
        a, b = spanning(g, lambda x: ring.chained(x, np.full(len(x), start)))  # noqa: B023
        yield g[a], g[b]
    short = np.repeat((length > 1) & (length <= SHORT), length)
    k, f = k[short], f[short]
    at, to = [], []
    for d in range(1, SHORT):
        same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else ()
        if not len(same):
            break
        ok = same[ring.chained(f[same] ^ f[same + d], k[same] & 255)]
        at.append(ok)
        to.append(ok + d)
    if at:
        i, j = np.concatenate(at), np.concatenate(to)
        kept = forest(len(k), i, j, np.bitwise_count(f[i] ^ f[j]).sum(1, dtype=np.int64))
        yield f[i[kept]], f[j[kept]]


def _link_runs(batches, ring: Ring):
    """Reads (key, fp) sorted by both; gives links, and blocks of the fingerprints of very long runs."""
    keys, fps, flushed = np.zeros(0, np.int64), np.zeros((0, ring.words), np.uint64), 0
    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy()]
        fps = np.concatenate([fps, _array(batch.column(1), ring.words)])
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            if flushed and (n := int(np.searchsorted(keys, keys[0], "right"))):
                yield _rows(True, keys[:n], flushed, fps[:n], fps[:n])
                keys, fps, last, flushed = keys[n:], fps[n:], last - n, 0
            for a, b in _linked(ring, keys[:last], fps[:last]) if last else ():
                yield _rows(False, 0, 0, a, b)
            keys, fps = keys[last:], fps[last:]
        while len(keys) > 2 * BLOCK:
            yield _rows(True, keys[:BLOCK], flushed, fps[:BLOCK], fps[:BLOCK])
            keys, fps, flushed = keys[BLOCK:], fps[BLOCK:], flushed + 1
    if flushed:
        yield _rows(True, keys, flushed, fps, fps)
    elif len(keys):
        for a, b in _linked(ring, keys, fps):
            yield _rows(False, 0, 0, a, b)


def links(fps: DataFrame, max_distance: int = 4, words: int = 1, segments: int | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fps`` (column fp) that connect every class."""
    ship(fps.sparkSession)
    if max_distance < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    ring, n = Ring(words, max_distance, segments), partitions(fps.sparkSession)

    def keyed(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                f = _array(b.column(0).slice(at, 2048), words)
                keys = ring.keys(f)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), _binary(np.tile(f, (len(keys), 1)))], ["key", "fp"])

    probes = fps.select("fp").mapInArrow(keyed, "key long, fp binary").repartition(n, "key").sortWithinPartitions("key", "fp")
    found = checkpoint(probes.mapInArrow(lambda it: _link_runs(it, ring), "hot boolean, key long, block long, a binary, b binary"))
    out = found.where(~F.col("hot")).select("a", "b")
    hot = found.where("hot")
    if not hot.isEmpty():
        blocks = hot.groupBy("key").agg(F.max("block").alias("last"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
        pairs = hot.join(blocks, "key").select("key", "block", "a", other).select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "a")

        def block_pairs(batches):
            def done(key, group):
                f = np.unique(np.concatenate(group), axis=0)
                a, b = spanning(f, lambda x: ring.chained(x, np.full(len(x), key & 255)))
                yield pa.RecordBatch.from_arrays([_binary(f[a]), _binary(f[b])], ["a", "b"])

            held, name = [], None
            for b in batches:
                ids = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
                f = _array(b.column(3), words)
                cuts = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, len(ids)]
                for s, e in zip(cuts[:-1], cuts[1:]):
                    if e > s:
                        if name is not None and tuple(ids[s]) != name:
                            yield from done(int(name[0]), held)
                            held = []
                        name = tuple(ids[s])
                        held.append(f[s:e])
            if held:
                yield from done(int(name[0]), held)

        out = out.unionByName(pairs.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(block_pairs, "a binary, b binary"))
    return out.distinct()


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's shingles."""
    return np.unique(_hashes(set(_grams(text, shingle)), 0).view("<u8"))


def frequent(texts: DataFrame, shingle: int, sample: int = SAMPLE, least: int = 2, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that ``least`` of some ``sample`` rows of ``texts`` (text) have, and their ranks by number of rows."""
    ship(texts.sparkSession)

    def run(batches):
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                hashes = np.unique(_hashes(set(_grams(t.as_buffer().to_pybytes(), shingle)), 42).view("<i8"))
                for i in range(0, len(hashes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + (1 << 16)])], ["key"])

    rows = texts.count()
    some = texts.sample(sample / rows, 1) if rows > sample else texts
    counts = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "key").limit(most).toArrow()
    keys, order = found["key"].to_numpy().view(np.uint64), np.arange(found.num_rows)[::-1]
    by = np.argsort(keys)
    return keys[by], order[by]


def _released(spark, wait: bool = True) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more, now and not when the driver's heap fills."""
    gc.collect()
    left = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(20 * wait):  # py4j's thread tells the JVM within a second what Python has let go of
        if not left:
            break
        time.sleep(0.1)
    spark._jvm.java.lang.System.gc()


def _least(n, share: float):
    """The least number of ``n`` that is that share of them."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def prefix(hashes: np.ndarray, similarity: float, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of sorted distinct hashes the first n - ceil(similarity * n) + 1 in the order of all shingles; ``known``: of ``frequent``."""
    keys, ranks = known
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        rank = np.where(keys[at] == hashes, ranks[at], -1)
        hashes = hashes[np.argsort(rank, kind="stable")]
    return hashes[: len(hashes) - int(_least(np.float64(len(hashes)), similarity)) + 1]


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int, similarity: float) -> DataFrame:
    """(id, digest, fp, node, size, prefix, sketch): as ``fingerprints`` of distinct shingles; 128 bits that stand for the set of shingles, how many it has, the hashes of its prefix and its sketch."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = frequent(docs.select(text), shingle)
    _released(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            fps, nodes, sizes, firsts, drawn = [], [], [], [], []
            for t in b.column(2).cast(pa.large_binary()):
                data = t.as_buffer().to_pybytes()
                grams = set(_grams(data, shingle))
                own = _hashes(grams, 42)
                fps.append(bytes(8 * words) if b"" in grams else b"".join([_majority(own), *(_majority(_hashes(grams, s)) for s in range(43, 42 + words))]))
                own = np.unique(own.view("<u8"))
                nodes.append(xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                firsts.append(prefix(own, similarity, known).tobytes())
                drawn.append(sketch(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.binary()), pa.array(drawn, pa.binary())], ["id", "digest", "fp", "node", "size", "prefix", "sketch"])

    return docs.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text")).mapInArrow(run, f"id {kind}, digest string, fp binary, node binary, size long, prefix binary, sketch binary")


_HELD = ["key", "class", "size", "place", "short"]
_MET = ["run", "class", "size", "short"]
_CELL = "run long, block long, class long, size long, short long"


def _can(rows: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) can reach the similarity if the key is the first they share: by sizes, and by what follows it in both."""
    x, y = rows[2, i], rows[2, j]
    follow = np.minimum(x - rows[3, i], y - rows[3, j])
    return _near(x, y, similarity) & (follow >= _least(x + y, similarity / (1 + similarity)))


def _near(x, y, similarity: float):
    """Whether sets of ``x`` and ``y`` shingles can reach the similarity."""
    return np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9


def _meetings(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of runs of one key (as ``_HELD``, sorted by key and class) that have a pair in another class, and where their runs begin."""
    begin = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
    length = np.diff(np.r_[begin, rows.shape[1]])
    mixed = rows[1, begin] != rows[1, begin + length - 1]
    rows, long = rows[:, np.repeat(mixed, length)], np.repeat(length[mixed] > SHORT, length[mixed])
    met, key, cls = long.copy(), rows[0], rows[1]
    at = np.flatnonzero(~long)
    for d in range(1, SHORT):
        at = at[at < len(key) - d]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        i = at[cls[at] != cls[at + d]]
        i = i[_can(rows, i, i + d, similarity)]
        met[i] = met[i + d] = True
    rows = rows[:, met]
    return rows, np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]]) if rows.shape[1] else np.zeros(0, np.int64)


def _runs(batches, similarity: float, most: int):
    """Reads ``_HELD`` sorted by key and class; gives ``_MET``: texts that share a key and may be similar, each such company once.

    A run's number comes from who is in it, so what many shingles say in the same way is said once for each task. Runs of
    over ``most`` rows, which are not held, keep their key as their number.
    """
    seen: set[int] = set()

    def given(run: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(run), *map(pa.array, rows[[1, 2, 4]])], _MET)

    def met(rows: np.ndarray):
        rows, begin = _meetings(rows, similarity)
        if len(begin):
            company = np.add.reduceat(mix(rows[4].view(np.uint64)), begin).view(np.int64)
            fresh = np.zeros(len(begin), bool)
            for i, x in enumerate(company.tolist()):
                if x not in seen:
                    if len(seen) >= 1 << 19:
                        seen.clear()
                    seen.add(x)
                    fresh[i] = True
            length = np.diff(np.r_[begin, rows.shape[1]])
            yield given(np.repeat(company[fresh], length[fresh]), rows[:, np.repeat(fresh, length)])

    rows, flushed = np.zeros((5, 0), np.int64), False
    for batch in batches:
        rows = np.concatenate([rows, np.stack([c.to_numpy() for c in batch.columns])], 1)
        last = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
        if last:
            if flushed:
                n = int(np.searchsorted(rows[0], rows[0, 0], "right"))
                yield given(rows[0, :n], rows[:, :n])
                rows, last, flushed = rows[:, n:], last - n, False
            if last:
                yield from met(rows[:, :last])
            rows = rows[:, last:]
        if rows.shape[1] > most:
            yield given(rows[0], rows)
            rows, flushed = rows[:, :0], True
    if flushed:
        yield given(rows[0], rows)
    elif rows.shape[1]:
        yield from met(rows)


def _numbered(batches, block: int, most: int):
    """Reads ``_MET`` sorted by run, class and short; gives ``_CELL``, without repeats: -1 where a run is one block, else blocks of
    at most ``block`` rows and ``most`` shingles (a larger text stands alone). Runs of one class are left out if they are one block."""

    def cut(rows: np.ndarray, number: int) -> np.ndarray:
        total, out, at = np.cumsum(rows[2]), np.zeros(rows.shape[1], np.int64), 0
        while at < len(out):
            to = min(at + block, max(at + 1, int(np.searchsorted(total, total[at] - rows[2, at] + most, "right"))))
            out[at:to] = number
            at, number = to, number + 1
        return out

    def given(rows: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[0], numbers, *rows[1:])], ["run", "block", "class", "size", "short"])

    def whole(rows: np.ndarray):
        begin = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        length = np.diff(np.r_[begin, rows.shape[1]])
        mixed = rows[1, begin] != rows[1, begin + length - 1]
        alone = (length <= block) & (np.add.reduceat(rows[2], begin) <= most)
        few = rows[:, np.repeat(alone & mixed, length)]
        yield given(few, np.full(few.shape[1], -1))
        for at, n in zip(begin[~alone & mixed], length[~alone & mixed]):
            yield given(rows[:, at : at + n], cut(rows[:, at : at + n], 0))

    rows, number = np.zeros((4, 0), np.int64), 0
    for batch in batches:
        rows = np.concatenate([rows, np.stack([c.to_numpy() for c in batch.columns])], 1)
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]] if rows.shape[1] else rows
        last = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
        if last:
            if number:
                n = int(np.searchsorted(rows[0], rows[0, 0], "right"))
                yield given(rows[:, :n], cut(rows[:, :n], number))
                rows, last, number = rows[:, n:], last - n, 0
            if last:
                yield from whole(rows[:, :last])
            rows = rows[:, last:]
        while rows.shape[1] > 4 * block:
            numbers = cut(rows[:, : 2 * block], number)
            yield given(rows[:, : 2 * block], numbers)
            rows, number = rows[:, 2 * block :], int(numbers[-1]) + 1
    if rows.shape[1]:
        yield from [given(rows, cut(rows, number))] if number else whole(rows)


def companies(marks: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(run, x, y, second, class, size, short): every pair of nodes of different classes (``groups``: node, root) that can reach
    the similarity stands in some run, in block x and block y (``second``) or both in x where x = y; short: 64 bits of the node.

    ``marks``: (node, size, prefix), a node in any number of rows. The rows grow with those of the prefixes, not with pairs.
    """
    spark = marks.sparkSession
    ship(spark)
    n = partitions(spark)
    sets = marks.groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    sets = sets.join(groups, "node", "left").select(F.xxhash64(F.coalesce("root", "node")), "size", F.xxhash64("node"), "prefix")

    def keyed(batches):
        for b in batches:
            firsts = [x.as_buffer().to_pybytes() for x in b.column(3)]
            at = 0
            while at < len(firsts):  # some 2^18 rows at once
                to, total = at, 0
                while to < len(firsts) and (to == at or total + len(firsts[to]) // 8 <= 1 << 18):
                    total += len(firsts[to]) // 8
                    to += 1
                count = [len(x) // 8 for x in firsts[at:to]]
                place = np.concatenate([np.arange(x) for x in count])
                columns = [np.repeat(c.slice(at, to - at).to_numpy(), count) for c in b.columns[:3]]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(firsts[at:to]), "<i8")), *map(pa.array, columns[:2]), pa.array(place), pa.array(columns[2])], _HELD)
                at = to

    rows = sets.mapInArrow(keyed, ", ".join(f"{x} long" for x in _HELD)).repartition(n, "key").sortWithinPartitions("key", "class")
    runs = rows.mapInArrow(partial(_runs, similarity=similarity, most=8 * BLOCK), ", ".join(f"{x} long" for x in _MET))
    runs = runs.repartition(n, "run").sortWithinPartitions("run", "class", "short")
    found = checkpoint(runs.mapInArrow(partial(_numbered, block=BLOCK, most=SHINGLES), _CELL))
    zero = F.lit(0).cast("long")
    out = found.where("block < 0").select("run", zero.alias("x"), zero.alias("y"), zero.alias("second"), "class", "size", "short")
    many = found.where("block >= 0")
    if not many.isEmpty():
        blocks = many.groupBy("run", "block").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
        x, y = (blocks.select("run", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "lo", "hi"))) for side in "xy")
        cells = x.join(y, "run").where("block_x <= block_y and least(lo_x, lo_y) < greatest(hi_x, hi_y)").select("run", F.col("block_x").alias("x"), F.col("block_y").alias("y"))
        sides = cells.select("run", "x", "y", F.col("x").alias("block"), zero.alias("second"))
        sides = sides.union(cells.where("x < y").select("run", "x", "y", "y", F.lit(1).cast("long")))
        out = out.unionByName(many.join(sides, ["run", "block"]).select("run", "x", "y", "second", "class", "size", "short"))
    return out


def _cells(batches, read):
    """What ``read`` gives for the rows of block x and those of block y of each cell; batches: (run, x, y, second, ...) sorted by these."""
    held, name = ([], []), None
    for b in batches:
        ids = np.stack([b.column(i).to_numpy() for i in range(4)], 1)
        cuts = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, len(ids)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e > s:
                if name is not None and tuple(ids[s, :3]) != name:
                    yield held
                    held = ([], [])
                name = tuple(ids[s, :3])
                held[ids[s, 3]].extend(read(b.slice(s, e - s)))
    if held[0]:
        yield held


def _placed(cells: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """Rows of ``cells`` with their nodes (short, node, ...), a cell in one task; two nodes of the same 64 bits are a row each."""
    rows = cells.join(nodes, "short").select("run", "x", "y", "second", "class", "size", "node", *more)
    return rows.repartition(partitions(cells.sparkSession), "run", "x", "y").sortWithinPartitions("run", "x", "y", "second", "class")


def sketch(hashes: np.ndarray, most: int = 2048) -> bytes:
    """The parity of how many of the distinct ``hashes`` fall on each of so many bits as there are hashes (a power of two, 64 to ``most``).

    Two sketches differ in no more bits than their sets do in members; the longer one, folded, is one of the shorter length.
    """
    bits = min(most, 1 << max(6, (len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes >> np.uint64(17) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def close(sketches: list[bytes], sizes: np.ndarray, classes: np.ndarray, split: int, similarity: float) -> np.ndarray:
    """Which sets have one of another class that can be that similar by ``sketch``; pairs as of ``linking``."""
    length, met = np.array([len(x) for x in sketches]), np.zeros(len(sketches), bool)
    for n in np.unique(length):  # pairs whose shorter sketch has that length; of similar sizes the other has twice that at most
        at = np.flatnonzero((length == n) | (length == 2 * n))
        x = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], "<u8").reshape(-1, n // 8), 0) for i in at])
        for k, i in enumerate(at):
            to = np.flatnonzero((at >= split if i < split else at < split) if split < len(sketches) else at > i)
            to = to[(classes[at[to]] != classes[i]) & ((length[i] == n) | (length[at[to]] == n))]
            to = to[_near(sizes[i], sizes[at[to]], similarity)]
            if len(to):
                apart = np.bitwise_count(x[to] ^ x[k]).sum(1, dtype=np.int64)
                to = to[apart <= (sizes[i] + sizes[at[to]]) * (1 - similarity) / (1 + similarity) + 1e-6]
                met[at[to]] = True
                met[i] |= len(to) > 0
    return met


def closer(cells: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``cells`` (as of ``companies``) that may have a link in their cell by ``sketches`` (node, sketch)."""
    ship(cells.sparkSession)

    def compared(batches):
        for first, second in _cells(batches, lambda b: list(zip(*(c.to_pylist() for c in b.columns)))):
            *ids, classes, sizes, nodes, made = zip(*first, *second)
            met = close(made, np.array(sizes), np.array(classes), len(first), similarity)
            if met.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (*ids, classes, sizes)), pa.array(nodes, pa.binary())], ["run", "x", "y", "second", "class", "size", "node"]).filter(pa.array(met))

    made = sketches.groupBy("node").agg(F.first("sketch").alias("sketch")).withColumn("short", F.xxhash64("node"))
    left = _placed(cells, made, "sketch").mapInArrow(compared, "run long, x long, y long, second long, class long, size long, node binary")
    return left.withColumn("short", F.xxhash64("node")).drop("node")


def unlinked(marks: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of nodes of different classes (``groups``: node, root) that meet in ``companies``, which ``confirmed`` compares
    without listing them: they can grow with the square of a group. ``marks``: (node, size, prefix), a node in any number of rows."""

    def listed(batches):
        for first, second in _cells(batches, lambda b: list(zip(*(b.column(i).to_pylist() for i in (4, 5, 6))))):
            for i, (cls, size, node) in enumerate(first):
                pairs = [sorted((node, y[2])) for y in second or first[i + 1 :] if y[0] != cls and _near(size, y[1], similarity)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs)], ["a", "b"])

    nodes = marks.select(F.xxhash64("node").alias("short"), "node").distinct()
    return _placed(companies(marks, groups, similarity), nodes).mapInArrow(listed, "a binary, b binary").distinct()


def linking(sets: list[np.ndarray], classes: list[int], split: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs (numbers of ``sets``) of that Jaccard similarity that connect whatever all such pairs of different classes do:
    pairs of the first ``split`` sets and the others, or of all if there are no others."""
    n, size = len(sets), np.array([len(x) for x in sets])
    comp, out = np.unique(classes, return_inverse=True)[1], []
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owner, tokens = np.repeat(np.arange(n), size)[order], tokens[order]
    begin = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    count = np.diff(np.r_[begin, len(tokens)])
    which = np.empty(len(tokens), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), count)
    first = np.r_[0, np.cumsum(size)]
    for i in range(split):
        to = np.arange(split if split < n else i + 1, n)
        to = to[comp[to] != comp[i]]
        if len(to):
            t = which[first[i] : first[i + 1]]
            t = t[count[t] > 1]
            c = count[t]
            at = np.repeat(begin[t] - np.cumsum(c) + c, c) + np.arange(c.sum())
            both = np.bincount(owner[at], minlength=n)[to]
            to = to[both >= similarity * (size[i] + size[to] - both) - 1e-9]
            for cls, j in zip(*np.unique(comp[to], return_index=True)):
                out.append((i, int(to[j])))
                comp[comp == cls] = comp[i]
    return out


def confirmed(cells: DataFrame, held: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links of that similarity between nodes of different classes that connect whatever all such links in ``cells`` (as of
    ``companies``) connect; ``held``: (node, text). Pairs are compared where they meet; only links leave a task."""
    ship(cells.sparkSession)

    def compared(batches):
        known: dict[bytes, np.ndarray] = {}
        total = 0

        def read(b):
            nonlocal total
            for cls, node, text in zip(b.column(4).to_pylist(), b.column(6).to_pylist(), b.column(7)):
                if node not in known:
                    if total > SHINGLES:
                        known.clear()
                        total = 0
                    known[node] = shingle_set(text.as_buffer().to_pybytes(), shingle)
                    total += len(known[node])
                yield cls, node, known[node]

        for first, second in _cells(batches, read):
            classes, nodes, sets = zip(*first, *second)
            pairs = linking(sets, classes, len(first), similarity)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in x], pa.binary()) for x in zip(*pairs)], ["a", "b"])

    texts = held.select(F.xxhash64("node").alias("short"), "node", F.col("text").cast("binary").alias("text"))
    return _placed(cells, texts, "text").mapInArrow(compared, "a binary, b binary")


def held_texts(asked: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes ``asked`` for (short: 64 bits of theirs); ``marks``: (digest, node), ``texts``: (digest, text)."""
    marks = marks.select("digest", "node", F.xxhash64("node").alias("short"))
    asked = marks.join(asked.select("short").distinct().hint("rebalance"), "short").groupBy("node").agg(F.min("digest").alias("digest"))  # all texts of a node have one set
    return checkpoint(texts.join(asked.hint("rebalance"), "digest").groupBy("node").agg(F.min("text").alias("text")))


def alike(pairs: DataFrame, held: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose texts (``held``: node, text) reach the similarity."""
    ship(pairs.sparkSession)

    def compared(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            known: dict[bytes, np.ndarray] = {}
            for i in range(b.num_rows):
                sets = []
                for c in (0, 1):
                    node = b.column(c)[i].as_py()
                    if node not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[node] = shingle_set(b.column(c + 2)[i].as_buffer().to_pybytes(), shingle)
                    sets.append(known[node])
                both = len(np.intersect1d(*sets, assume_unique=True))
                ok[i] = both >= similarity * (len(sets[0]) + len(sets[1]) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    first = held.select(F.col("node").alias("a"), F.col("text").cast("binary").alias("at"))
    second = held.select(F.col("node").alias("b"), F.col("text").cast("binary").alias("bt"))
    return pairs.hint("rebalance").join(first, "a").hint("rebalance").join(second, "b").select("a", "b", "at", "bt").mapInArrow(compared, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star rounds, each cut by a checkpoint, until the links no longer change.
    """

    def rooted(pairs: DataFrame, keep: Column) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))

    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sign = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = sign
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = rooted(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        down = large.union(large.select("u", "u")).where("v <= u")
        small = rooted(down, F.lit(True)).where("u <> v").distinct()
        e = checkpoint(small)
        _released(e.sparkSession, wait=False)  # a round's shuffles are files for each task, however few links there are


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row for each row of ``docs``: (id_col, fingerprint, component_id)."""
    marks = checkpoint(fingerprints(docs, id_col, text_col, shingle).select("id", "fp"))
    nodes = marks.groupBy("fp").agg(F.min("id").alias("least"))
    groups = checkpoint(components(links(nodes, max_distance)))
    roots = groups.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("of_root"))
    classes = nodes.join(groups, F.col("fp") == F.col("node"), "left").join(roots, "root", "left").select("fp", F.coalesce("of_root", "least").alias("component_id"))
    return marks.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def similar(marks: DataFrame, texts: DataFrame, proposed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the classes of all pairs of nodes that reach the similarity; ``marks``: as of ``signed``.

    Links that fingerprints propose come first: what they join needs no more pairs.
    """
    digests, of = marks.select("digest", "node"), marks.select("fp", "node").distinct()
    stands = of.groupBy("fp").agg(F.min("node").alias("stands"))
    pairs = proposed
    for c in "ab":
        pairs = pairs.withColumnRenamed(c, "fp").join(stands, "fp").drop("fp").withColumnRenamed("stands", c)
    equal = of.join(stands, "fp").where("node <> stands").select(F.col("stands").alias("a"), F.col("node").alias("b"))
    pairs = checkpoint(pairs.unionByName(equal))
    held = held_texts(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("short")), digests, texts)
    _released(marks.sparkSession)
    found = checkpoint(alike(pairs, held, shingle, similarity))
    groups = checkpoint(components(found))
    _released(marks.sparkSession)
    cells = companies(marks.select("node", "size", "prefix"), groups, similarity)
    _released(marks.sparkSession)
    cells = checkpoint(closer(cells, marks.select("node", "sketch"), similarity))
    _released(marks.sparkSession)
    held = held_texts(cells, digests, texts)
    _released(marks.sparkSession)
    more = checkpoint(confirmed(cells, held, shingle, similarity))
    _released(marks.sparkSession)
    return groups if more.isEmpty() else checkpoint(components(found.unionByName(more)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float | None = 0.8, max_distance: int = 26, segments: int | None = 17, words: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, that of the least id, then of the least MD5 of its text.

    Fingerprints are of distinct shingles. With a similarity the classes are those of all pairs of texts that reach it.
    """
    if similarity is None:
        marks = checkpoint(fingerprints(docs, id_col, text_col, shingle, words, True).withColumn("node", F.col("fp")))
        groups = checkpoint(components(links(marks.select("fp").distinct(), max_distance, words, segments)))
    else:
        marks = checkpoint(signed(docs, id_col, text_col, shingle, words, similarity))
        found = checkpoint(links(marks.select("fp").distinct(), max_distance, words, segments))
        _released(docs.sparkSession)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        groups = similar(marks, docs.select(F.md5(text).alias("digest"), text.alias("text")), found, shingle, similarity)
    groups = groups.withColumnRenamed("node", "of")
    of = marks.join(groups, F.col("node") == F.col("of"), "left").select(F.coalesce("root", "node").alias("class"), F.struct(F.col("id").isNull().alias("none"), "id", "digest").alias("row"))
    keep = checkpoint(of.groupBy("class").agg(F.min("row").alias("row"))).select("class", "row.id", "row.digest")
    repeated = not of.join(keep.select("class", F.col("id").alias("k"), F.col("digest").alias("d")).hint("rebalance"), "class").where(F.col("row.id").eqNullSafe(F.col("k")) & (F.col("row.digest") == F.col("d"))).groupBy("class").count().where("count > 1").isEmpty()
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("of"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sum"))
    out = whole.join(keep, (F.col("sum") == F.col("digest")) & F.col("of").eqNullSafe(F.col("id")))
    return (out.dropDuplicates(["class"]) if repeated else out).select("row.*")
