"""Packing and the quality classifier."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import packing, quality_model


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_library(tokenizer, corpus):
    encode = packing.encoder(None, None)
    odd = ["", " ", "  a", "a  b", " a ", "a\n b", "a \nb", "don't we'll", "x<|endoftext|>y", "\u00a0a \u00a0", "a\u3000 b", "1 22 333", "...  ,,", "tab\tx", "end ", "日本 語", "\x1c a"]
    for t in [*odd, *(t or "" for _, t, _ in corpus)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_and_sequences(docs, corpus, tokenizer):
    cut = packing.pieces(docs, 64).collect()
    placed = packing.pack(packing.pieces(docs, 64), 64, group=40).collect()
    assert sorted(map(str, cut)) == sorted(str(r)[: str(r).index(", sequence_id")] + ")" for r in placed)
    ids = defaultdict(list)
    for d, t, _ in corpus:
        ids[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    for r in cut:
        whole = ids[r.doc_id][0]
        assert zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.length == (64 if r.piece else (len(whole) - 1) % 64 + 1)
    at = defaultdict(list)
    for r in placed:
        at[r.sequence_id].append((r.offset, r.length))
    for held in at.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 64
    total = sum(r.length for r in cut)
    assert len(at) <= 1.1 * -(-total // 64) + 4


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_constraint_holds(by):
    rng = np.random.default_rng(0)
    n = np.sort(rng.integers(1, 101, 3000))[::-1]
    b, o = packing.best_fit(n, 100, 4, 6000.0 + 4001, (1.0, 0.5, 0.5), by)
    for s in range(b.max() + 1):
        mine = n[b == s]
        assert mine.sum() <= 100 and len(mine) <= 4 and (mine.astype(float) ** 2).sum() <= 10001
        assert (np.sort(o[b == s]) == np.r_[0, np.cumsum(mine[np.argsort(o[b == s])])[:-1]]).all()


def test_best_fit_chooses_the_best(monkeypatch):
    """The scan with bounds finds what looking at all sequences finds."""
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(1, 65, 300))[::-1]
    weights, cap, docs, cost = (1.0, 0.3, 0.2), 64, 5, 64.0**2
    got, _ = packing.best_fit(n, cap, docs, cost, weights)
    state = []
    for i, x in enumerate(n.tolist()):
        norm = lambda s: weights[0] * ((s[0] - x) / cap) ** 2 + weights[1] * ((s[1] - 1) / docs) ** 2 + weights[2] * ((s[2] - x * x) / cost) ** 2  # noqa: B023, E731
        fits = [norm(s) for s in state if s[0] >= x and s[1] >= 1 and s[2] >= x * x]
        if fits:
            chosen = state[got[i]]
            assert abs(norm(chosen) - min(fits)) < 1e-9
            chosen[0], chosen[1], chosen[2] = chosen[0] - x, chosen[1] - 1, chosen[2] - x * x
        else:
            assert got[i] == len(state)
            state.append([cap - x, docs - 1, cost - x * x])


def test_best_fit_looks_at_all_sequences_of_equal_residual_tokens():
    """300 sequences of 90, five of 50 and 40, then eights: the fit is among those of equal tokens, by the minor weights."""
    n = np.array([90] * 300 + [50] * 5 + [40] * 5 + [8] * 10)
    for by in ("norm", "dot"):
        got, _ = packing.best_fit(n, 100, 100, 10000.0, (1, 0.05, 0.01), by)
        state, weights = [], (1, 0.05, 0.01)
        for i, x in enumerate(n.tolist()):
            cost = float(x * x)

            def rank(s):
                if by == "norm":
                    return weights[0] * ((s[0] - x) / 100) ** 2 + weights[1] * ((s[1] - 1) / 100) ** 2 + weights[2] * ((s[2] - cost) / 1e4) ** 2  # noqa: B023
                return -(weights[0] * x * s[0] / 1e4 + weights[1] * s[1] / 1e4 + weights[2] * cost * s[2] / 1e8)  # noqa: B023

            fits = [rank(s) for s in state if s[0] >= x and s[1] >= 1 and s[2] >= cost]
            if fits:
                assert abs(rank(state[got[i]]) - min(fits)) < 1e-12
            else:
                state.append([100, 100, 1e4])
            s = state[got[i]]
            s[0], s[1], s[2] = s[0] - x, s[1] - 1, s[2] - cost


def test_packing_keeps_wide_and_null_ids_and_repeated_rows(spark):
    rows = [(2**60 + 1, "a b"), (2**60 + 3, "c d"), (None, "e f")] + [(5, "same text")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "group": F.lit(2)})
    cut = packing.pieces(docs, 64).withColumns({"row": F.lit(1), "nth": F.lit(2)})
    got = packing.pack(cut, 64, group=10)
    assert got.columns == [*cut.columns, "sequence_id", "offset"]
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in rows)
    assert len({r.sequence_id >> 36 for r in found if r.doc_id == 5}) > 5  # equal rows are dealt out too


def test_a_piece_must_fit():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([10]), 9, 5, 100.0)


def test_whole_sequences(docs, tokenizer, corpus):
    rows = packing.sequences(docs.where("doc_id is not null"), 64).collect()
    assert all(0 < len(r["ids"]) <= 64 for r in rows)
    want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, _ in corpus if d is not None)
    assert sum(len(r["ids"]) for r in rows) == want


def test_packing_empty(empty):
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_classifier_learns(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = [word() for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "x"))
        labels.append((i, int(good)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "abc", "x"), (0, rows[0][1], "x")]
    labels += [(1000, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, idx string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality_model.train(docs, marks.where("doc_id % 4 <> 2"), bits=14)
    assert (weights == quality_model.train(docs.repartition(5), marks.where("doc_id % 4 <> 2"), bits=14)).all()
    got = quality_model.score(docs, weights).join(marks, "doc_id").where("doc_id % 4 = 2")
    assert got.where((F.col("score") >= 0.5).cast("int") == F.col("quality")).count() == got.count() > 100
    scored = {r.doc_id: r.score for r in quality_model.score(docs, weights).collect()}
    assert len(scored) == 603 and scored[1000] == scored[1001] and 0 <= scored[1000] <= 1


def grams(text, order=2):
    """Counts of token n-grams, by looking at each character."""
    kind = lambda c: 0 if ord(c) < 33 or ord(c) == 127 else 1 if c.isalnum() and ord(c) < 128 or ord(c) > 127 else 2
    tokens, last = [], 0
    for c in text or "":
        if kind(c) and kind(c) == last:
            tokens[-1] += c
        elif kind(c):
            tokens.append(c)
        last = kind(c)
    return Counter(tuple(tokens[i : i + k]) for k in range(1, order + 1) for i in range(len(tokens) - k + 1))


def test_classifier_matches_brute_force(spark, docs, corpus):
    """Features are the n-grams' log counts, updates are those of the plain algorithm, scores are dot products."""
    bits, rates = 20, {"alpha": 0.7, "beta": 1.0, "l1": 0.05, "l2": 0.2}
    rows = [(d, t) for d, t, _ in corpus if d is not None and len(t or "") < 2000][:40]
    table = quality_model.features(spark.createDataFrame([(d, d % 2, t) for d, t in dict(rows).items()], "id long, y int, text string"), bits)
    held = table.collect()
    texts, names = dict(rows), {}
    for r in held:
        want = grams(texts[r.id])
        norm = np.sqrt(sum(np.log1p(n) ** 2 for n in want.values()))
        assert len(set(r.idx)) == len(r.idx)
        if len(r.idx) == len(want):  # none of the text's n-grams share a feature
            assert np.allclose(sorted(r.val), sorted(np.log1p(n) / norm for n in want.values()), atol=1e-6)
            names[r.id] = r.idx
    assert len(names) > 30
    weights = quality_model.fit(table, bits, epochs=2, seed=5, **rates)
    order = [r.id for r in spark.createDataFrame([(r.id,) for r in held], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    by = {r.id: r for r in held}
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= rates["l1"]:
            return 0.0
        return -(z[i] - np.sign(z[i]) * rates["l1"]) / ((rates["beta"] + n[i] ** 0.5) / rates["alpha"] + rates["l2"])

    for epoch in range(2):
        for k in np.random.default_rng(5 + epoch).permutation(len(order)):
            r = by[order[k]]
            x = [*zip(r.idx, r.val), (1 << bits, 1.0)]
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x)))
            new = []
            for i, v in x:
                g = (p - r.y) * v
                new.append((i, g, ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / rates["alpha"] * weight(i)))
            for i, g, s in new:
                z[i] += g - s
                n[i] += g * g
    assert np.allclose(weights[list(z)], [weight(i) for i in z], atol=1e-5)
    assert np.count_nonzero(weights) == sum(weight(i) != 0 for i in z) > 100
    scored = {r.id: r.score for r in quality_model.score(spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("row", F.lit(1)), weights).collect()}
    for r in held:
        assert abs(scored[r.id] - 1 / (1 + np.exp(-(sum(weight(i) * v for i, v in zip(r.idx, r.val)) + weight(1 << bits))))) < 1e-5


def test_training_is_bounded(spark):
    rows = [(i % 50, f"word{i} word{i % 7}") for i in range(3000)]  # ids that repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    once = spark.createDataFrame([(i, min(t for d, t in rows if d == i)) for i in range(50)], "doc_id long, text string")
    assert (quality_model.train(docs, marks, bits=12) == quality_model.train(once, marks, bits=12)).all()
    assert np.count_nonzero(quality_model.train(docs, marks, bits=12, most_values=30)) < np.count_nonzero(quality_model.train(docs, marks, bits=12))


def test_classifier_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality_model.train(docs, none, bits=10)
    assert {r.score for r in quality_model.score(docs, weights).collect()} == {0.5}
    assert quality_model.score(empty, weights).count() == 0
