"""Best-fit packing of token pieces into fixed-length sequences.

Tokenising is a map over the rows. Texts are cut before each single space that has no other white space beside
it, which is always a boundary of the byte-level pre-tokeniser, and the ids of each cut are remembered, so that
common words are encoded once a worker.

Packing is vector best-fit decreasing: each piece needs tokens, one document slot and attention cost (length
squared), and each sequence has a residual capacity of the three. Of all open sequences with room in every
dimension, the piece goes to the one with the least weighted residual norm, or with the greatest weighted
dot product of need and residual; the choice is exact. Sequences are indexed by residual tokens, then by residual
document slots, then sorted by residual attention cost, where a search finds the best one; residual tokens are
visited from the best bound outwards. Pieces are dealt into groups of a bounded number; only narrow rows move, never
token ids. The sequences that groups cost are measured in the README.

Edge cases: null and empty texts are the closing id alone; rows that repeat a doc_id, or are equal, are packed each; an
empty table gives no rows; extra columns are not read; ids of any type, null ones among them, come back as they were.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, loose, ship

#: Pieces in one packing group: what one task holds, and enough that a group's last sequences don't matter.
GROUP = 50_000

_BESIDE = re.compile(r" \s|\s ")
_LONGEST, _ENTRIES = 64, 400_000


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library."""

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.plain = lambda s: np.array(plain(s), "<u4").tobytes()

        class Known(dict):
            def __missing__(known, word):
                ids = self.plain(" " + word)
                if len(word) <= _LONGEST:
                    if len(known) >= _ENTRIES:
                        known.clear()
                    known[word] = ids
                return ids

        self.after_space = Known().__getitem__

    def __call__(self, text: str) -> bytes:
        if "<|" in text:  # special tokens' strings
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _BESIDE.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.after_space, rest))


@lru_cache(2)
def encoder(tokenizer: str | None, ranks: str | None) -> Encoder:
    """One a worker process."""
    return Encoder(tokenizer, ranks)


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut where longer than ``capacity``.

    All pieces but the first are ``capacity`` long, so that a long text leaves one remainder.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer, ranks)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                data = encode(t.as_py() or "") + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if at == 0 else capacity
                    part = data[4 * at : 4 * (at + size)]
                    for to, x in ((row, i), (piece, k), (start, at), (length, size), (crc, zlib.crc32(part))):
                        to.append(x)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4"))
                    at, k = at + size, k + 1
            out = {"id": b.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int, most_documents: int, most_attention: float, weights=(1.0, 0.01, 0.01), by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Of pieces in the given order (longest first is best): each one's sequence, and its place there."""
    whole = (float(capacity), float(most_documents), float(most_attention))
    w = [x / c**2 for x, c in zip(weights, whole)]
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    documents: list[float] = []
    attention: list[float] = []
    # room[residual tokens][residual documents]: sorted (residual attention cost, sequence)
    room: dict[int, dict[float, list[tuple[float, int]]]] = {}
    order: list[int] = []
    opened = 0

    def put(b: int, left: int) -> None:
        if left <= 0 or documents[b] < 1:
            return
        if left not in room:
            room[left] = {}
            insort(order, left)
        insort(room[left].setdefault(documents[b], []), (attention[b], b))

    for i, n in enumerate(lengths.tolist()):
        cost = float(n) * n
        if n > capacity or cost > most_attention or most_documents < 1:
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        best, found, low = float("inf"), None, bisect_left(order, n)
        scan = range(low, len(order)) if by == "norm" else range(len(order) - 1, low - 1, -1)
        for j in scan:
            left = order[j]
            if by == "norm":
                bound = w[0] * (left - n) ** 2
            else:
                bound = -(w[0] * n * left + w[1] * most_documents + w[2] * cost * most_attention)
            if bound >= best:
                break
            for slots, held in room[left].items():
                # the least attention cost with room has the least norm, the greatest has the greatest dot product
                k = bisect_left(held, (cost, -1)) if by == "norm" else bisect_left(held, (held[-1][0], -1))
                if k == len(held) or held[k][0] < cost:
                    continue
                if by == "norm":
                    score = bound + w[1] * (slots - 1) ** 2 + w[2] * (held[k][0] - cost) ** 2
                else:
                    score = -(w[0] * n * left + w[1] * slots + w[2] * cost * held[k][0])
                if score < best:
                    best, found = score, (left, slots, k)
        if found is None:
            b, left = opened, capacity
            opened += 1
            documents.append(most_documents)
            attention.append(most_attention)
        else:
            left, slots, k = found
            _, b = room[left][slots].pop(k)
            if not room[left][slots]:
                del room[left][slots]
            if not room[left]:
                del room[left]
                order.pop(bisect_left(order, left))
        at[i], offset[i] = b, capacity - left
        documents[b] -= 1
        attention[b] -= cost
        put(b, left - n)
    return at, offset


def pack(items: DataFrame, capacity: int = 2048, most_documents: int | None = None, most_attention: float | None = None, weights=(1.0, 0.01, 0.01), by: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds (sequence_id, offset) to rows that have a ``length`` of 1 to ``capacity``.

    ``most_documents`` and ``most_attention`` (the sum of squared lengths) bind where they are given; else
    they are what ``capacity`` implies.
    """
    ship(items.sparkSession)
    narrow = [c for c in items.columns if c not in ("ids", "sequence_id", "offset")]
    # numbered once checkpointed, so that a group is the same whenever a lost executor's part of it is made again
    items = checkpoint(items.select(F.struct(*narrow).alias("row"), F.col("length").cast("long").alias("length")))
    groups = max(1, -(-items.count() // group))
    docs_cap, cost_cap = most_documents or capacity, most_attention or float(capacity) ** 2

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("nth", "ascending")]).combine_chunks()
        b, o = best_fit(t.column("length").to_numpy(), capacity, docs_cap, cost_cap, weights, by)
        ids = b + (t.column("group").to_numpy().astype(np.int64) << 36)
        row = t.column("row")
        return pa.table({"row": row.cast(loose(row.type)), "sequence_id": pa.array(ids), "offset": pa.array(o)})

    dealt = items.withColumn("nth", F.monotonically_increasing_id())
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("nth"), F.lit(groups)).cast("int"))
    found = dealt.groupBy("group").applyInArrow(run, f"row {items.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return found.select(*(F.col("row")[c].alias(c) for c in narrow), "sequence_id", "offset")


def sequences(docs: DataFrame, capacity: int = 2048, **how) -> DataFrame:
    """(sequence_id, ids, documents): whole packed sequences, each of at most ``capacity`` ids."""
    cut = checkpoint(pieces(docs, capacity, with_ids=True))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = pack(cut.drop("ids"), capacity, **how)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    both = placed.withColumn("_nth", nth).join(cut.withColumn("_nth", nth), [*key, "_nth"])
    held = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"), F.transform("held", lambda x: x["doc_id"]).alias("documents"))
