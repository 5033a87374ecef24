from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import exchange as X
from locusframe.llm import lm, substring
from locusframe.llm.common import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\n\t ", max_size=40)), max_size=6))
def test_word_tables(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(WORD.findall(t or ""))]
    got = [(int(r), int(a), w.data[s:e].tobytes().decode()) for r, a, s, e in zip(w.row, w.at, w.start, w.end)]
    assert got == want
    by_hash = {}
    for (_, _, x), h in zip(want, w.hash.tolist()):
        assert by_hash.setdefault(x, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 300), st.integers(20, 64))
def test_parts_round_trip(values, count, bits):
    h = np.unique(np.array(values, np.uint64))
    parts, seen = X.Parts(count, bits), []
    for p, s in parts.split(h):
        assert (parts.of(h[s]) == p).all()
        a, b = X.unsqueeze(X.squeeze(X.steps(parts.short(p, h[s])), np.arange(s.stop - s.start, dtype=np.uint64)))
        back = parts.whole(p, np.cumsum(a, dtype=np.uint64))
        assert (back == parts.cut(h[s])).all() and len(b) == len(back)
        seen += back.tolist()
    assert len(seen) == len(h)
    if bits == 64:
        assert seen == h.tolist()


def brute_repeats(corpus, window):
    order = lambda d: math.inf if d is None else d
    first = {}
    for d, t, _ in corpus:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(order(d), first.get(k, math.inf))
    out = []
    for d, t, _ in corpus:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), kept))
    return sorted(out)


@pytest.mark.parametrize("window,block", [(13, 7), (5, 3), (2, 1)])
def test_repeats_match_brute_force(docs, corpus, window, block):
    found = substring.repeats(docs, window, block).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == brute_repeats(corpus, window)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_digests(docs):
    for r, d in zip(*(sorted(f.collect(), key=lambda r: (str(r.doc_id), r.n_words)) for f in (substring.repeats(docs), substring.digests(substring.repeats(docs))))):
        assert hashlib.sha256(r.kept.encode()).hexdigest() == d.kept_sha256


def test_a_block_must_fit(docs):
    with pytest.raises(ValueError):
        substring.repeats(docs, 13, 8)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(docs, corpus, order):
    counts, total = Counter(), 0
    for _, t, _ in corpus:
        w = WORD.findall(t or "")
        total += len(w)
        counts.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    want = []
    for d, t, _ in corpus:
        w, x = WORD.findall(t or ""), 0.0
        for i in range(len(w)):
            m = min(i + 1, order)
            for k in range(m, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1 or counts[g] >= 2:
                    x += math.log(counts[g] / (counts[g[:-1]] if k > 1 else total)) + (m - k) * math.log(0.4)
                    break
        want.append((str(d), len(w), round(x, 6)))
    got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 6) + 0.0) for r in lm.scores(docs, order).collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert all(abs(g[2] - w[2]) < 1e-5 for g, w in zip(got, sorted(want)))


def test_relational_scores_are_the_same(docs):
    key = lambda r: (str(r.doc_id), r.n_words, round(r.log_score, 4) + 0.0)
    for order in (1, 3):
        assert sorted(map(key, lm.relational(docs, order).collect())) == sorted(map(key, lm.scores(docs, order).collect()))


def test_words_that_collide_modulo_a_power_of_two(spark):
    a = "a"
    while len(a) < 1024:  # the Thue-Morse word and its complement
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    w = Words(pa.array([a, b]))
    assert w.hash[0] != w.hash[1]
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_word_hashes_of_any_length():
    from locusframe.llm import common

    full = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & full
        h = (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & full
        return h ^ h >> 32

    words = ["x", "é日本", "12345678", "123456789", "abc" * 500, "z" * 5000, "q" * 70000, "x"]
    w = Words(pa.array([" ".join(words), "x y", "x"]))
    for x, h in zip([*words, "x", "y", "x"], w.hash.tolist()):
        data = x.encode()
        want = len(data) * 0x9E3779B97F4A7C15 & full
        for i in range(0, len(data), 8):
            want = mixed(((want ^ int.from_bytes(data[i : i + 8], "little")) + 0xD6E8FEB86659FD93) & full)
        assert h == (want if len(data) <= common._LONG else int.from_bytes(hashlib.sha256(data).digest()[:8], "big"))


def test_empty(empty):
    assert lm.relational(empty).count() == 0
    assert substring.repeats(empty).count() == 0
    assert lm.scores(empty).count() == 0
