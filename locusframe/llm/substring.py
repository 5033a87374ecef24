"""Substring deduplication with fixed-block anchors.

A repeat of at least ``window`` words contains, wherever it lies, one whole block of the grid of non-overlapping
``block``-word blocks that starts at each document's first word, if 2 * block - 1 <= window. So the blocks of all
documents are the index, and every rolling ``block``-word window is a probe (1, 2). A hit is extended to all
``window``-word windows around it; those that also start in a document of a smaller id are repeats, and every word
of them is removed, so that what goes is the union of the maximal exact repeats (3, 4, 5).

1. each bucket sends the distinct hashes of its rolling windows, marked where they are grid blocks;
2. each part answers with the blocks that more than one document holds;
3. each bucket extends those hits and sends the hashes of the candidate windows, with the least id of each;
4. each part answers with the windows that another bucket holds under a smaller id;
5. each bucket removes the words and gives the kept text.

Anchors keep ``anchor_bits`` bits within their part; false hits only cost a candidate. Windows of different buckets
are held to be equal if 128 bits agree, two 64-bit hashes of the window made of the words' hashes; windows of one bucket,
which is of bounded size, if the first 64 do.

Edge cases: null and empty texts have no words; rows that repeat a doc_id never repeat each other, as neither id
is smaller; a null id is greater than all others; ids are integers (or cast to them) below 2**63 - 1; extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, partitions
from .exchange import NO_ID, Parts, back, dealt, documents, meet, places, send, squeeze, steps, unsqueeze

SCHEMA = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"


def _runs(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _least(h: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes, sorted, the least id of each, and one of each of ``more``."""
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    at = _runs(h)
    return h[at], np.minimum.reduceat(ids, at) if len(at) else ids, *(m[order][at] for m in more)


def _second(w: Words, window: int) -> np.ndarray:
    """Hashes of windows that are independent of those of ``rolling``'s own factor."""
    return w.rolling(window, 3, 0xD1342543DE82EF95)[1]


def _flat(x: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(x) if x else np.zeros(0, kind)


def repeats(docs: DataFrame, window: int = 13, block: int = 7, anchor_bits: int = 38, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): each document without its repeats, and the word spans that went."""
    if not 1 <= block <= (window + 1) // 2:
        raise ValueError("a block must fit every window wherever it starts: 2 * block - 1 <= window")
    n = partitions(docs.sparkSession)
    held = dealt(docs, 2 * n, id_col, text_col)
    anchors, windows = Parts(n, anchor_bits), Parts(n)

    def probe(bucket, t):
        hs, us, grids = [], [], []
        for ids, texts in documents(t):
            w = Words(texts)
            at, h = w.rolling(block, 1)
            hs.append(h)
            us.append(ids[w.row[at]])
            grids.append(w.at[at] % block == 0)
        h, ids, grid = _flat(hs, np.uint64), _flat(us, np.int64), _flat(grids, bool)
        order = np.argsort(h)
        h, ids, grid = h[order], ids[order], grid[order]
        at = _runs(h)
        if not len(at):
            return []
        mark = np.logical_or.reduceat(grid, at).astype(np.uint64) | ((np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)).astype(np.uint64) << np.uint64(1))
        h = h[at]
        return [(p, bucket, squeeze(steps(anchors.short(p, h[s])), mark[s])) for p, s in anchors.split(h)]

    def shared(part, buckets, blobs):
        got = [unsqueeze(x) for x in blobs]
        r, mark = [np.cumsum(a, dtype=np.uint64) for a, _ in got], np.concatenate([b for _, b in got])
        sizes, r = [len(x) for x in r], np.concatenate(r)
        order = np.argsort(r)
        at = _runs(r[order])
        count, any_ = np.diff(np.r_[at, len(r)]), np.bitwise_or.reduceat(mark[order], at)
        good = ((any_ & np.uint64(1)) > 0) & ((count > 1) | ((any_ & np.uint64(2)) > 0))
        hit = np.empty(len(r), bool)
        hit[order] = np.repeat(good, count)
        out, s = [], 0
        for bucket, size in zip(buckets, sizes):
            x = r[s : s + size][hit[s : s + size]]
            s += size
            if len(x):
                out.append((part, bucket, squeeze(steps(x))))
        return out

    def extend(bucket, t, got):
        hits = _flat([anchors.whole(p, np.cumsum(unsqueeze(b)[0], dtype=np.uint64)) for p, b in got], np.uint64)
        hs, us, gs = [], [], []
        for ids, texts in documents(t) if len(hits) else ():
            w = Words(texts)
            at, h = w.rolling(block, 1)
            cut = anchors.cut(h)
            found = hits[np.minimum(places(hits, cut), len(hits) - 1)] == cut
            mark = np.zeros(len(w.hash) + 2, np.int64)
            mark[at[found] + 1] = 1
            total = np.cumsum(mark)
            at, h = w.rolling(window, 2)
            near = total[at + window - block + 1] > total[at]
            hs.append(h[near])
            us.append(ids[w.row[at[near]]])
            gs.append(_second(w, window)[near])
        h, ids, g = _least(_flat(hs, np.uint64), _flat(us, np.int64), _flat(gs, np.uint64))
        rows = [(p, bucket, squeeze(steps(windows.short(p, h[s])), ids[s].view(np.uint64), g[s])) for p, s in windows.split(h)]
        part, names, blob = zip(*rows) if rows else ((), (), ())
        return pa.table({"part": pa.array(part, pa.int32()), "bucket": pa.array(names, pa.int32()), "blob": pa.array(blob, pa.binary())})

    def earlier(part, buckets, blobs):
        got = [unsqueeze(x) for x in blobs]
        r = [np.cumsum(a, dtype=np.uint64) for a, *_ in got]
        ids, g, sizes, r = np.concatenate([b.view(np.int64) for _, b, _ in got]), np.concatenate([x for *_, x in got]), [len(x) for x in r], np.concatenate(r)
        order = np.lexsort((g, r))
        at = np.flatnonzero(np.r_[True, (r[order][1:] != r[order][:-1]) | (g[order][1:] != g[order][:-1])])
        least = np.empty(len(r), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.r_[at, len(r)]))
        out, s = [], 0
        for bucket, size in zip(buckets, sizes):
            x = r[s : s + size][least[s : s + size] < ids[s : s + size]]
            s += size
            if len(x):
                out.append((part, bucket, squeeze(steps(x))))
        return out

    def remove(bucket, t, got):
        foreign = _flat([windows.whole(p, np.cumsum(unsqueeze(b)[0], dtype=np.uint64)) for p, b in got], np.uint64)
        held, hs, us = [], [], []
        for ids, texts in documents(t):
            w = Words(texts)
            at, h = w.rolling(window, 2)
            held.append((ids, w, at, h))
            hs.append(h)
            us.append(ids[w.row[at]])
        known, least = _least(_flat(hs, np.uint64), _flat(us, np.int64))
        cols = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "removed")}
        while held:
            ids, w, at, h = held.pop(0)
            gone = np.zeros(len(w.hash) + 1, np.int64)
            if len(h):
                again = least[places(known, h)] < ids[w.row[at]]
                if len(foreign):
                    again |= foreign[np.minimum(places(foreign, h), len(foreign) - 1)] == h
                np.add.at(gone, at[again], 1)
                np.add.at(gone, at[again] + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for i, ident in enumerate(ids.tolist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                words, out = w.bytes_of(i).split(), gone[a:b]
                edges = np.flatnonzero(np.diff(np.r_[False, out, False])).reshape(-1, 2)
                if len(edges):
                    words = [words[j] for j in np.flatnonzero(~out)]
                cols["doc_id"].append(None if ident == NO_ID else ident)
                cols["n_words"].append(b - a)
                cols["n_removed"].append(int(out.sum()))
                cols["kept"].append(b" ".join(words).decode())
                cols["removed"].append([{"start": x, "end": y} for x, y in edges.tolist()])
        kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        return pa.table(cols, schema=kind)

    hits = meet(send(held, probe), shared)
    candidates = back(held, hits, extend, "part int, bucket int, blob binary")
    return back(held, meet(candidates, earlier), remove, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
