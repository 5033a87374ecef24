"""What the pipeline's stages must leave, on documents made for it."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, text string, n_chars int"


def page(rng: random.Random, lines: int, words: int = 12) -> str:
    """Written lines with blank ones between some of them."""
    out = []
    for _ in range(lines):
        out.append(" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(words)))
        out += [""] * (rng.random() < 0.2)
    return "\n".join(out)


def made(spark, rows):
    return spark.createDataFrame([(i, s, t, len(t)) for i, s, t in rows], SCHEMA).repartition(3)


def test_exact_copies_leave_one_document(spark):
    rng = random.Random(3)
    texts = [page(rng, n, 60 if n == 1 else 12) + "\n" * (n % 2) for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 30] * 3]
    rows = [(100 * c + i, "s", t) for c in range(4) for i, t in enumerate(texts)]
    left = corpus_pipeline.line_dedup(spark, made(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted((i, t) for i, t in enumerate(texts))
    assert all(r.n_chars == len(r.text) for r in left)


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def classes(texts, linked):
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and linked(texts[i], texts[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_near_duplicates_are_those_of_the_similarity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for family in range(25):  # copies with single words changed in 1 to 8 places, so on both sides of 0.8
        base = [word() for _ in range(rng.choice([12, 60, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["one two", "One  two", "one two three", ""]
    left = corpus_pipeline.near_dedup(spark, made(spark, [(i, "s", t) for i, t in enumerate(texts)]), "").collect()
    ids = {r.doc_id for r in left}
    assert len(ids) == len(left)
    # the classes of all pairs of the similarity, by brute force: none loses its first text, and nearly all are one
    group = classes(texts, lambda a, b: alike(a, b) >= 0.8)
    assert set(group) <= ids
    assert len(ids) <= len(set(group)) * 1.05
    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8]
    assert sum(i not in ids or j not in ids for i, j in links) >= 0.95 * len(links)
    assert 25 < len(ids) < len(texts) - 25


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c = (page(rng, 6) for _ in range(3))
    rows = [(None, "s", a), (None, "s", b), (None, "s", b), (7, "s", c), (7, "s", c + " x y"), (7, "s", page(rng, 6))]
    left = corpus_pipeline.near_dedup(spark, made(spark, rows), "").collect()
    assert len(left) == 4 and len({r.text for r in left}) == 4 and {a, b} <= {r.text for r in left}


def test_frequent_lines_of_a_host_are_removed(spark):
    rng = random.Random(6)
    common = "Terms of  use and\tprivacy of this SITE"
    texts = [page(rng, 8) for _ in range(30)]
    rows = [(i, "h", t.replace("\n", f"\n{common if i % 2 else common.lower()}\n", 1)) for i, t in enumerate(texts)]
    rows += [(100 + i, "g", page(rng, 6) + "\n" + common) for i in range(15)]  # another host, below the limits
    rows += [(200, "h", page(rng, 3) + "\n" + common + "\n" + common)]  # 50 words and more only with the lines
    rows += [(201, "h", "\n".join([page(rng, 5)] + [common] * 40)), (202, None, page(rng, 6))]
    want = {i: t for i, t in enumerate(texts)} | {i: t for i, _, t in rows if 100 <= i < 200 or i == 202}
    docs = made(spark, rows)
    left = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in left} == want and len(left) == len(want)
    assert all(r.n_chars == len(r.text) for r in left)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null, blank and repeated texts, clashing columns, no n_chars, no rows."""
    rng = random.Random(11)
    spark.createDataFrame([(1, page(rng, 3))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [page(rng, 8) for _ in range(6)]
    rows = [(i, "s", t) for i, t in enumerate(texts)] + [(0, "s", texts[0]), (None, None, texts[1]), (None, "s", None), (20, "s", ""), (21, None, " \n"), (22, "s", None)]
    clash = ("digest", "row", "class", "key", "gone", "fp", "of", "length", "group", "lines")
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in clash})
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert {str(r.text) for r in found} >= set(texts) and all(r[c] == c for r in found for c in clash), name
        left = stage(spark, left, str(tmp_path))
    # for the line stage a null id is the least
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None if i == 1 else i, t) for i, t in enumerate(texts)} and left.count() == 6
    packed = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    assert len(packed) == len(rows) and corpus_pipeline.best_fit_packing(spark, docs.limit(0), "").count() == 0
