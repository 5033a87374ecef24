"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's tokens are its runs of letters and digits (and characters beyond ASCII) and its runs of other printed
characters; all n-grams of up to ``order`` tokens are hashed into 2**bits features. A feature's value is log(1 + its count),
divided by the norm of all values of the text. A score is the logistic function of a sparse dot product with the weights,
which are 2**bits numbers whatever the input and are broadcast.

Training takes at most ``most_rows`` labelled rows, those with the least hash of their id, and stops at ``most_values``
feature values in the order of that hash; one task reads them as a sorted stream, and runs the updates over them
``epochs`` times, each in a seeded order.

Edge cases: null and empty texts score by the intercept alone; rows without a label or with a null id are
not learnt from; an id that has both labels is learnt as 1, one with several texts with the least of them; no labelled
rows give 0.5 for all; rows that repeat are scored each; extra columns are carried, but for one named score, which is
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, loose, mix, ship, spans

#: Token classes of bytes: 0 between tokens, 1 of letters and digits, 2 of other printed characters.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[list(range(33))] = 0
CLASSES[127] = 0
CLASSES[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1

#: Bytes of texts that are cut into n-grams at once.
PIECE = 1 << 22
#: Feature values that training holds at most (12 bytes each).
MOST_VALUES = 40_000_000


def _values(texts: pa.Array, bits: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a batch, by text and feature."""
    w = Words(texts, CLASSES)
    shift = np.uint64(64 - bits)
    hashes, rows = [mix(w.hash + np.uint64(1))], [w.row]
    for k in range(2, order + 1):
        at, h = w.rolling(k, k + 1)
        hashes.append(h)
        rows.append(w.row[at])
    cells, n = np.unique((np.concatenate(rows).astype(np.int64) << bits) | (np.concatenate(hashes) >> shift).astype(np.int64), return_counts=True)
    row, value = cells >> bits, np.log1p(n)
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    return row, cells & ((1 << bits) - 1), value / norm[row]


def features(docs: DataFrame, bits: int, order: int = 2, text_col: str = "text") -> DataFrame:
    """``docs`` with idx and val in the place of the text: the features of each and their values."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text_col, "idx", "val")]

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for s, e in spans(texts, PIECE):
                row, feature, value = _values(texts.slice(s, e - s), bits, order)
                ends = pa.array(np.searchsorted(row, np.arange(e - s + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s).cast(loose(b.column(0).type)), *lists], ["row", "idx", "val"])

    held = docs.select(F.struct(F.lit(0), *others).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, idx array<int>, val array<float>")
    return out.select(*(F.col("row")[c].alias(c) for c in others), "idx", "val")


class Leader:
    """Follow-the-regularised-leader with per-coordinate rates; weights are nought until their sum passes l1."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: DataFrame, bits: int = 18, epochs: int = 3, seed: int = 42, most_values: int = MOST_VALUES, **rates) -> np.ndarray:
    """Weights from (id, y, idx, val) rows, of which one task takes ``most_values`` values at most, in the order of their
    ids' hash; the last weight is the intercept."""

    def run(tables):
        y, idx, val, held = [], [], [], 0
        for t in tables:
            for label, i, v in zip(t.column("y").to_pylist(), t.column("idx"), t.column("val")):
                held += len(i)
                if held > most_values:
                    break
                y.append(label)
                idx.append(np.array(i.values))
                val.append(np.array(v.values))
            if held > most_values:
                break
        model, one = Leader((1 << bits) + 1, **rates), np.ones(1)
        for epoch in range(epochs):
            for i in np.random.default_rng(seed + epoch).permutation(len(y)):
                model.learn(np.r_[idx[i], 1 << bits], np.r_[val[i], one].astype(float), y[i])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], ["w"])

    sorted_rows = rows.select("id", "y", "idx", "val").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    found = sorted_rows.mapInArrow(run, "w binary").collect()
    return np.frombuffer(found[0]["w"], "<f4") if found else np.zeros((1 << bits) + 1, "f4")


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, order: int = 2, most_rows: int = 20_000, epochs: int = 3, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", **rates) -> np.ndarray:
    """Weights from the documents that ``labels`` marks 0 or 1: at most ``most_rows`` of them."""
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(most_rows).select(F.col(id_col).alias("id"), "y")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # most_rows rows at most
    texts = texts.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    return fit(features(texts, bits, order), bits, epochs, **rates)


def score(docs: DataFrame, weights: np.ndarray, order: int = 2, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score: 0 to 1, higher where label 1 is likelier."""
    ship(docs.sparkSession)
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype("f4"))
    others = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches):
        w = shared.value
        for b in batches:
            texts = b.column(1)
            for s, e in spans(texts, PIECE):
                row, feature, value = _values(texts.slice(s, e - s), bits, order)
                dot = np.bincount(row, w[feature] * value, e - s) + w[-1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s).cast(loose(b.column(0).type)), pa.array(1 / (1 + np.exp(-np.clip(dot, -30, 30))))], ["row", "score"])

    held = docs.select(F.struct(F.lit(0), *others).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, score double")
    return out.select(*(F.col("row")[c].alias(c) for c in others), "score")
