"""Language-model scores by stupid backoff.

Count tables of all n-grams of the corpus, for each order, are partitioned by n-gram hash; each bucket of
documents sends its own counts (a partial aggregate), each part sums them and answers with the totals, in the order in
which they were asked for, and each bucket joins its n-grams to the totals and sums the scores of each document.
``relational`` is the same as plain DataFrame joins, with a row for each n-gram; the README has figures of both.

A word scores count(n-gram) / count(context) at the longest order whose n-gram occurs ``min_count`` times or more
in the corpus, times ``backoff`` for each order it had to give up; a document's first words have shorter contexts,
at no cost. The unigram score is count / words of the corpus. With ``min_count`` 2, an n-gram of a single
occurrence, which is the one that is being scored, counts as unseen.

N-grams are told apart by 64 bits of hash.

Edge cases: null and empty texts have no words and a null mean; rows that repeat a doc_id are counted and scored
each; an empty corpus gives no rows; extra columns are not read. Ids are integers (or cast to them) below 2**63 - 1;
``relational`` takes any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpoint, partitions
from .exchange import NO_ID, Parts, back, dealt, documents, meet, places, send, squeeze, steps, unsqueeze
from .rules import words_in

#: Bytes of texts that are cut into n-grams at once.
PIECE = 1 << 21


def _counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(h, return_counts=True)
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n[order], at) if len(at) else n


def scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score): each document's words, and its sum of the words' log scores."""
    n = partitions(docs.sparkSession)
    held = dealt(docs, 2 * n, id_col, text_col)
    parts = Parts(n)

    def grams(w: Words):
        for k in range(1, order + 1):
            at, h = w.rolling(k, k)
            yield k, at, h

    def local(t):
        tables = []
        for ids, texts in documents(t, PIECE):
            w = Words(texts)
            tables.append(_counted(np.concatenate([h for _, _, h in grams(w)])))
        return _counted(*(np.concatenate(x) for x in zip(*tables)))

    def count(bucket, t):
        h, c = local(t)
        return [(p, bucket, squeeze(steps(parts.short(p, h[s])), c[s].astype(np.uint64))) for p, s in parts.split(h)]

    def total(part, buckets, blobs):
        got = [unsqueeze(x) for x in blobs]
        ends = np.cumsum([0, *(len(c) for _, c in got)])
        c = np.concatenate([c for _, c in got])
        r = np.concatenate([np.cumsum(a, dtype=np.uint64) for a, _ in got])
        del got  # one array at a time, as they are all of the part's size
        by = np.argsort(r)
        r = r[by]
        at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        del r
        sums = np.add.reduceat(c[by], at)
        length = np.diff(np.r_[at, len(c)])
        del at
        np.negative(c, out=c)  # what the other buckets have
        c[by] += np.repeat(sums, length)
        return [(part, bucket, squeeze(c[s:e])) for bucket, s, e in zip(buckets, ends[:-1], ends[1:]) if c[s:e].any()]

    def score(bucket, t, got):
        known, counts = local(t)
        counts = counts.astype(np.int64)
        asked = dict(parts.split(known))
        for p, b in got:
            counts[asked[p]] += unsqueeze(b)[0].astype(np.int64)
        names, words, sums = [], [], []
        for ids, texts in documents(t, PIECE):
            w = Words(texts)
            size = len(w.hash)
            value, settled, before = np.zeros(size), np.zeros(size, bool), None
            seen = {k: (at, counts[places(known, h)]) for k, at, h in grams(w)}
            dense = {}
            for k, (at, c) in seen.items():  # by the n-gram's last word
                dense[k] = np.zeros(size, np.int64)
                dense[k][at + k - 1] = c
            possible = np.minimum(w.at + 1, order)
            for k in range(order, 0, -1):
                open_ = ~settled & (possible >= k) & ((dense[k] >= min_count) if k > 1 else True)
                at = np.flatnonzero(open_)
                context = dense[k - 1][at - 1] if k > 1 else np.ones(len(at), np.int64)
                value[at] = np.log(dense[k][at] / context) + (possible[at] - k) * np.log(backoff)
                if k == 1:
                    before = at
                settled |= open_
            row = w.row
            names += ids.tolist()
            words.append(w.count)
            sums.append(np.stack([np.bincount(row, value, len(ids)), np.bincount(row[before], minlength=len(ids))], 1))
        both = np.concatenate(sums)
        return pa.table({"doc_id": pa.array([None if x == NO_ID else x for x in names], pa.int64()), "n_words": pa.array(np.concatenate(words).astype(np.int64)), "inner": pa.array(both[:, 0]), "n_single": pa.array(both[:, 1].astype(np.int64))})

    found = checkpoint(back(held, meet(send(held, count), total), score, "doc_id long, n_words long, inner double, n_single long"))
    words = found.agg(F.sum("n_words")).first()[0] or 1
    return found.select("doc_id", "n_words", (F.col("inner") - F.col("n_single") * F.log(F.lit(float(words)))).alias("log_score"))


def relational(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same scores by count tables joined to exploded n-grams, as DataFrame operations.

    N-grams are their words, so counts are exact. Counts are summed in two steps, and both sides of each join are shuffled
    on the n-gram with the count tables rebalanced, so that hot n-grams are split. A row of ``docs`` is named by its id and
    text: rows that are equal in both are scored once and joined back.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    texts = checkpoint(rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).select("doc_id", "copies", F.md5("text").alias("digest"), words_in(F.col("text")).alias("w")))
    gram = lambda i, k: F.when(i >= k - 1, F.array_join(F.slice("w", i - k + 2, k), " "))
    at = F.sequence(F.lit(0), F.size("w") - 1)
    grams = F.transform(at, lambda i: F.struct(F.least(i + 1, F.lit(order)).alias("possible"), *(gram(i, k).alias(f"g{k}") for k in range(1, order + 1)), *(F.when(i >= k, F.array_join(F.slice("w", i - k + 1, k), " ")).alias(f"c{k}") for k in range(1, order))))
    held = texts.where(F.size("w") > 0).select("doc_id", "digest", "copies", F.explode(grams).alias("s")).select("doc_id", "digest", "copies", "s.*")
    total = float(texts.agg(F.sum(F.size("w") * F.col("copies"))).first()[0] or 1)
    tables = {k: checkpoint(held.where(F.col(f"g{k}").isNotNull()).groupBy(F.col(f"g{k}").alias("g")).agg(F.sum("copies").alias("n"))) for k in range(1, order + 1)}
    for k in range(1, order + 1):
        held = held.join(tables[k].select(F.col("g").alias(f"g{k}"), F.col("n").alias(f"n{k}")).hint("rebalance"), f"g{k}", "left")
        if k < order:
            held = held.join(tables[k].select(F.col("g").alias(f"c{k}"), F.col("n").alias(f"m{k}")).hint("rebalance"), f"c{k}", "left")
    value = F.log(F.col("n1") / total) + (F.col("possible") - 1) * float(np.log(backoff))
    for k in range(2, order + 1):
        value = F.when(F.col(f"n{k}") >= min_count, F.log(F.col(f"n{k}") / F.col(f"m{k - 1}")) + (F.col("possible") - k) * float(np.log(backoff))).otherwise(value)
    sums = held.groupBy("doc_id", "digest").agg(F.count("*").alias("n_words"), F.sum(value).alias("log_score"))
    named = rows.select("doc_id", F.md5("text").alias("digest"))
    out = named.join(sums.select(F.col("doc_id").alias("of"), F.col("digest").alias("sum"), "n_words", "log_score").hint("rebalance"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("sum")), "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
