from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import simhash as S


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def classes(marks, most):
    """{fingerprint: root} by comparing all pairs."""
    fps = sorted(set(marks))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_matches_brute_force(docs, corpus):
    marks = [(d, fingerprint(t)) for d, t, _ in corpus]
    root = classes([f for _, f in marks], 4)
    least = {}
    for d, f in marks:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(((str(d), f"{f:016x}", least.get(root[f])) for d, f in marks), key=str)
    got = sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert len({g[2] for g in got}) < len(got) - 5


def test_links_find_every_class(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = set(centres)
    for c in centres:
        x = c
        for _ in range(rng.randint(0, 30)):  # a chain of steps of at most four bits
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    for most in (1, 3, 4, 6):
        nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "fp binary")
        edges = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in S.links(nodes, most).collect()]
        assert all((a ^ b).bit_count() <= most for a, b in edges)
        groups = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in S.components(S.links(nodes, most)).collect()}
        want = classes(fps, most)
        together = {}
        for f in fps:
            together.setdefault(want[f], set()).add(groups.get(f, f))
        assert all(len(v) == 1 for v in together.values())
        assert len({next(iter(v)) for v in together.values()}) == len(together)


def bits(fps):
    return np.array([[f] for f in fps], np.uint64)


def test_long_runs_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "SHORT", 8)
    rng = random.Random(2)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 150:
        fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "fp binary")
    keys = np.zeros(len(fps), np.int64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(keys), S._binary(bits(sorted(fps)))], ["key", "fp"])
    rows = [r for b in S._link_runs(iter([batch.slice(0, 100), batch.slice(100)]), S.Ring(1, 4)) for r in b.to_pylist()]
    assert sum(r["hot"] for r in rows) == len(fps) and len({r["block"] for r in rows}) > 3
    groups = {bytes(r.root) for r in S.components(S.links(nodes, 4)).collect()}
    assert len(groups) == 1


def test_runs_of_any_length_keep_to_the_chains(monkeypatch):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(50) for _ in range(rng.randint(0, 5))) for _ in range(300)})
    ring, f = S.Ring(1, 4), bits(fps)
    start = next(i for i, (at, _) in enumerate(ring.segments) if at >= 50)
    budgets = lambda a, b: all(((a ^ b) & int(ring.masks[start, n, 0])).bit_count() <= n for n in range(ring.m))
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if budgets(a, b)]
    assert {(a, b) for a, b in want} == {(fps[i], fps[j]) for i in range(len(fps)) for j in range(i + 1, len(fps)) if len(ring.chained(f[[i]] ^ f[[j]], np.array([start])))}
    for short in (4, 1000):  # one after the other, and all at once
        monkeypatch.setattr(S, "SHORT", short)
        got = [(int(a[0]), int(b[0])) for x, y in S._linked(ring, np.full(len(f), start), f) for a, b in zip(x, y)]
        assert all(budgets(a, b) for a, b in got) and len(got) < len(fps)

        def split(links):
            parent = {x: x for x in fps}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in links:
                parent[find(a)] = find(b)
            groups = {}
            for x in fps:
                groups.setdefault(find(x), set()).add(x)
            return {frozenset(g) for g in groups.values()}

        assert split(got) == split(want)


def test_wide_fingerprints_and_keys():
    rng = random.Random(9)
    ring = S.Ring(2, 26, 17)
    assert sum(w for _, w in ring.segments) == 128
    whole = [rng.getrandbits(128) for _ in range(50)]
    f = np.array([[x >> 64, x & (1 << 64) - 1] for x in whole], np.uint64)
    for i, (at, width) in enumerate(ring.segments):
        assert ring.part(f, i).tolist() == [x >> at & (1 << width) - 1 for x in whole]
    assert S._array(S._binary(f), 2).tolist() == f.tolist()
    keys = ring.keys(f)
    assert len(keys) == 128 and len(set(keys[:, 0].tolist())) == 128
    text = b"a b c d e f g a b c d e f g"
    assert S.simhash(text, 5, 2, True)[:8] == S.simhash(b"a b c d e f g a b c d", 5, 1, True) != S.simhash(text, 5)


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_deduplicate_keeps_one_of_each_group(spark, docs, corpus):
    kept = S.deduplicate(docs.withColumns({c: F.lit("clash") for c in ("fp", "id", "digest", "class", "row", "of", "sum", "a", "root")}))
    assert kept.columns == [*docs.columns, "fp", "id", "digest", "class", "row", "of", "sum", "a", "root"]
    sets = [shingled(t) for _, t, _ in corpus]
    group = list(range(len(corpus)))
    for i in range(len(corpus)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {}
    for g, (d, t, _) in zip(group, corpus):
        want[g] = min(want.get(g, (True, 0, "")), (d is None, d or 0, t or ""))
    assert sorted(want.values()) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())


def families(rng, sizes, copies):
    """Texts whose similarities lie on both sides of 0.8: words changed, put in, left out, or added at the end."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for size in sizes:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(1, max(2, size // 25))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1, 1, 2])] = [word()] * rng.randint(0, 1)
            yield " ".join(copy + [word() for _ in range(rng.choice([0, 0, size // 8]))])


def brute(texts):
    """The number of each text's class by all pairs."""
    sets = [shingled(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return group


@pytest.mark.parametrize("block", [4096, 16])
def test_deduplicate_leaves_out_no_pair_of_the_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    texts = list(families(random.Random(12), [9, 14, 30, 60, 100, 100, 200, 400], 40))
    group = brute(texts)
    want = {group.index(g) for g in group}
    assert len(want) > 100 and len(texts) - len(want) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in S.deduplicate(docs).collect()} == want


@pytest.mark.parametrize("block", [4096, 16])
def test_pairs_of_different_classes_come_from_runs_of_any_length(spark, monkeypatch, block):
    """Every pair that can reach the similarity is asked for, whatever shingles are frequent and however blocks fall."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(13)
    texts = list(families(rng, [12, 40, 100], 50))
    whole = [S._hashes(set(S._grams(t.encode(), 5)), 42).view("<u8") for t in texts]
    known = np.unique(rng.sample([int(x) for w in whole for x in w], 100)).astype(np.uint64)
    sets = [(bytes([i]) * 16, len(w), S.prefix(np.unique(w), 0.8, (known, np.arange(len(known)))).tobytes()) for i, w in enumerate(whole)]
    marks = spark.createDataFrame(sets + sets[:9], "node binary, size long, prefix binary")
    root = [i - i % 3 for i in range(len(texts))]
    groups = spark.createDataFrame([(bytes([i]) * 16, bytes([r]) * 16) for i, r in enumerate(root) if i < 120], "node binary, root binary")
    got = [tuple(sorted((r.a[0], r.b[0]))) for r in S.unlinked(marks, groups, 0.8).collect()]
    of = [root[i] if i < 120 else i for i in range(len(texts))]
    words = [shingled(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if of[i] != of[j] and len(words[i] & words[j]) >= 0.8 * len(words[i] | words[j])}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 100
    assert all(of[i] != of[j] for i, j in got)


def test_texts_just_below_the_similarity_are_not_listed_as_pairs(spark, monkeypatch):
    """What is written between the phases grows with a group of such texts, not with its square."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(179)]
    texts = [" ".join(base + [word() for _ in range(25)]) for _ in range(320)]
    texts += [t.rsplit(" ", 1)[0] for t in texts[::40]]  # some links beside
    real, made, group = S.checkpoint, [], brute(texts)

    def counted(df):
        out = real(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(S, "checkpoint", counted)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of a large table the sample knows few shingles
    monkeypatch.setattr(S, "frequent", lambda *_: none)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in S.deduplicate(docs).collect()} == {group.index(g) for g in group}
    assert len(set(group)) > 250
    # proposals of fingerprints, the second table, are a forest for each key; pairs of texts are 51,040
    assert max(made[:1] + made[2:]) < 20 * len(texts), made


def test_links_of_a_cell_join_whatever_its_pairs_join():
    rng = random.Random(15)
    texts = list(families(rng, [9, 30, 100], 30))
    rng.shuffle(texts)
    sets = [S.shingle_set(t.encode(), 5) for t in texts]
    n = len(sets)
    for classes, split in ((range(n), n), ([i // 3 for i in range(n)], n), ([i // 3 for i in range(n)], 40), ([0] * n, n)):
        def joined(links):
            group = list(range(n))
            for i, j in [*links, *((i, j) for j in range(n) for i in range(j) if classes[i] == classes[j])]:
                group = [group[i] if g == group[j] else g for g in group]
            return {frozenset(i for i in range(n) if group[i] == g) for g in group}

        alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
        want = [(i, j) for i in range(split) for j in range(split if split < n else i + 1, n) if classes[i] != classes[j] and alike(i, j)]
        got = S.linking(sets, list(classes), split, 0.8)
        assert set(got) <= set(want) and joined(got) == joined(want)
        assert len(got) < max(1, len(want))


def test_sketches_lose_no_pair_of_the_similarity():
    rng = random.Random(16)
    texts = list(families(rng, [9, 14, 60, 63, 100, 250, 2000, 5000], 15))
    rng.shuffle(texts)
    sets = [S.shingle_set(t.encode(), 5) for t in texts]
    made, n = [S.sketch(x) for x in sets], len(sets)
    assert {len(x) for x in made} >= {8, 16, 32, 256} and max(len(x) for x in made) == 256
    sizes, alike = np.array([len(x) for x in sets]), np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            alike[i, j] = alike[j, i] = len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    for classes, split in ((np.arange(n), n), (np.arange(n) // 3, n), (np.arange(n) // 3, 50)):
        asked = alike & (classes[:, None] != classes)
        if split < n:
            asked[:split, :split] = asked[split:, split:] = False
        met = S.close(made, sizes, classes, split, 0.8)
        assert met[asked.any(1)].all() and asked.any(1).sum() > 20
    assert not S.close(made, sizes, np.zeros(n), n, 0.8).any()
    apart = [S.shingle_set(" ".join(str(rng.random()) for _ in range(size)).encode(), 5) for size in [100] * 20 + [600] * 20]
    assert not S.close([S.sketch(x) for x in apart], np.array([len(x) for x in apart]), np.arange(40), 40, 0.8).any()


def test_runs_are_met_once_and_numbered_in_blocks():
    import pyarrow as pa

    def read(batches):
        return [tuple(r.values()) for b in batches for r in b.to_pylist()]

    held = [(k, c, 10, 0, 100 * c + i) for k in (1, 2) for c in range(2) for i in range(3)]  # the same company for two keys
    held += [(3, 5, 10, 0, i) for i in range(4)]  # one class
    held += [(4, 6, 10, 0, 1), (4, 7, 30, 0, 2)]  # sizes too far apart
    batch = pa.RecordBatch.from_pylist([dict(zip(S._HELD, x)) for x in held])
    met = read(S._runs([batch.slice(0, 5), batch.slice(5)], 0.8, 100))
    assert len(met) == 6 and len({x[0] for x in met}) == 1 and {x[3] for x in met} == {x[4] for x in held[:6]}
    long = read(S._runs([batch.slice(0, 4), batch.slice(4, 8), batch.slice(12)], 0.8, 3))
    assert {(1, *x[1:3], x[4]) for x in held[:6]} <= set(long)
    rows = [(1, c, 10, i) for c in range(2) for i in range(20) for _ in range(2)] + [(2, 0, 10, 1), (2, 1, 10, 2), (3, 0, 10, 1), (3, 0, 10, 2)]
    batch = pa.RecordBatch.from_pylist([dict(zip(S._MET, x)) for x in rows])
    for cuts in ([0, len(rows)], [0, 7, 50, 60, len(rows)]):
        for block, most in ((4, 1000), (40, 35), (16, 1000)):
            got = read(S._numbered([batch.slice(s, e - s) for s, e in zip(cuts, cuts[1:])], block, most))
            assert sorted((x[0], *x[2:]) for x in got) == sorted(set(rows[:-2]))
            assert {x[1] for x in got if x[0] == 2} == {-1} and {x[1] for x in got if x[0] == 1} == set(range(max(x[1] for x in got) + 1))
            assert all(sum(y[:2] == x[:2] for y in got) <= min(block, most // 10) for x in got if x[1] >= 0)


def test_frequent_shingles_are_last_in_the_order(spark):
    texts = spark.createDataFrame([(f"{i} x{i} y z own{i} the same five words here",) for i in range(8)], "text string")
    keys, ranks = S.frequent(texts, 5)
    common = np.unique(S._hashes([b"the same five words here"], 42).view("<u8"))
    assert keys.tolist() == common.tolist() and ranks.tolist() == [0]
    hashes = np.unique(np.r_[common, np.arange(1, 12, dtype=np.uint64)])
    assert common[0] not in S.prefix(hashes, 0.8, (keys, ranks)) and S.prefix(hashes, 0.0, (keys, ranks))[-1] == common[0]
    assert [len(S.prefix(np.arange(n, dtype=np.uint64), 0.8, (keys, ranks))) for n in (1, 4, 5, 10, 300)] == [1, 1, 2, 3, 61]


def test_empty(empty):
    assert S.near_duplicates(empty).count() == 0
    assert S.deduplicate(empty).count() == 0
