from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import sequence as Q
from locusframe.operators import variants


def one(spark, seq, column):
    return spark.createDataFrame([(seq,)], "s string").select(column(F.col("s")).alias("x")).first().x


def brute_kmers(seq, k):
    ind = ["ACGT".find(c.upper() if c.isascii() else c) for c in seq]
    return [-1 if min(ind[i : i + k]) < 0 else sum(d * 4 ** (k - 1 - j) for j, d in enumerate(ind[i : i + k])) for i in range(len(ind) - k + 1)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_kmers(spark, k):
    rng = random.Random(k)
    for seq in ("", "A", "acgtN", "ß" * 3, "".join(rng.choice("ACGTacgtN") for _ in range(60))):
        assert one(spark, seq, lambda c: Q.kmers(c, k)) == brute_kmers(seq, k)
        turned = one(spark, seq, lambda c: Q.rc_kmers(Q.kmers(c, k), k))
        assert turned == brute_kmers(seq[::-1].replace("a", "A").replace("c", "C").replace("g", "G").replace("t", "T").translate(str.maketrans("ACGT", "TGCA")), k)


def test_protein_and_labels(spark):
    assert one(spark, "ACWYX", lambda c: Q.kmers(c, 1, "protein")) == [0, 1, 18, 19, -1]
    assert Q.labels(2)[:5] == ["AA", "AC", "AG", "AT", "CA"] and len(Q.labels(1, "protein")) == 20
    with pytest.raises(ValueError):
        Q.alphabet("rna")


def test_one_hot_padding_and_windows(spark):
    hot = one(spark, "ACN", lambda c: Q.one_hot(Q.kmers(c)))
    assert hot == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]]
    assert one(spark, "ACG", lambda c: Q.pad(c, 5)) == "ACG.." and one(spark, "ACG", lambda c: Q.pad(c, 2)) == "AC"
    assert one(spark, "ACGT", lambda c: Q.extract(c, F.lit(2), F.lit(7))) == "GTNNN"


@pytest.mark.parametrize("k", [1, 2, 3])
def test_rc_permutation_is_an_involution(k):
    p = Q.rc_permutation(k)
    assert [p[p[i]] for i in range(4**k)] == list(range(4**k))


def test_motif_scan(spark):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGTN") for _ in range(40))
    for order in (1, 2):
        w = [[rng.uniform(-1, 1) for _ in range(4**order)] for _ in range(3)]
        k = brute_kmers(seq, order)
        forward = [sum(w[j][k[i + j]] if k[i + j] >= 0 else 0 for j in range(3)) for i in range(len(k) - 2)]
        r = brute_kmers(seq[::-1].translate(str.maketrans("ACGT", "TGCA")), order)
        reverse = [sum(w[j][r[i + j]] if r[i + j] >= 0 else 0 for j in range(3)) for i in range(len(r) - 2)][::-1]
        assert one(spark, seq, lambda c: Q.scan_both_strands(Q.kmers(c, order), w, order)) == pytest.approx(np.maximum(forward, reverse).tolist())
        assert one(spark, seq, lambda c: Q.scan_both_strands(Q.kmers(c, order), w, order, "ave")) == pytest.approx(((np.array(forward) + reverse) / 2).tolist())
    with pytest.raises(ValueError):
        Q.scan_both_strands(F.col("x"), w, 1, "median")


def test_local_average(spark):
    got = spark.range(1).select(Q.local_average(F.array(*map(F.lit, [1.0, 2.0, 6.0, 3.0])), 2).alias("x")).first().x
    assert got == [1.5, 4.0, 4.5]


def test_contexts_across_chunks(spark):
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(1000))
    chunks = variants.chunked(spark.createDataFrame([("c", seq)], "chrom string, seq string"), 64)
    rows = [(i, "c", s, s + n) for i, (s, n) in enumerate(product((0, 60, 64, 500, 990), (1, 10, 200)))]
    got = variants.with_context(spark.createDataFrame(rows, "k long, chrom string, start long, end long"), chunks, "k", 64).collect()
    assert len(got) == len(rows)
    assert all(r.context == seq[r.start : r.end].ljust(r.end - r.start, "N") for r in got)


def test_admissible_variants(spark):
    rows = [(0, "c", 50, "a", "A", "C"), (1, "c", 50, "noalt", "A", ""), (2, "c", 50, "multi", "A", "C,G"), (3, "c", 50, "indel", "AT", "C"), (4, "c", 1, "first", "A", "C"), (5, "c", 50, "odd", "N", "C"), (6, "c", 5, "edge", "A", "c")]
    got = variants.admissible(spark.createDataFrame(rows, "ord long, chrom string, pos long, name string, ref string, alt string"), 10)
    assert [(r.name, r.start, r.end) for r in got.orderBy("ord").collect()] == [("a", 45, 55), ("edge", 0, 10)]


@pytest.mark.parametrize("binsize", [9, 10])
@pytest.mark.parametrize("order", [1, 2])
def test_alleles(spark, binsize, order):
    rng = random.Random(6)
    seq = "".join(rng.choice("ACGT") for _ in range(200))
    wrong = {"A": "C", "C": "G", "G": "T", "T": "A"}
    rows = [(i, "c", p, f"v{i}", seq[p - 1] if i % 2 else wrong[seq[p - 1]], wrong[wrong[seq[p - 1]]]) for i, p in enumerate((60, 120, 180))]
    df = spark.createDataFrame(rows, "ord long, chrom string, pos long, name string, ref string, alt string")
    genome = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    notes = spark.createDataFrame([("c", 100, 130, "-"), ("c", 110, 140, "+")], "chrom string, start long, end long, strand string")
    for ignore in (False, True):
        for annotation in (None, notes):
            for r in variants.stream(df, genome, binsize, order, annotation, ignore).collect():
                _, _, p, _, ref, alt = rows[r.ord]
                start = p - binsize // 2 + (binsize % 2 == 0) - 1
                context = seq[start : start + binsize]
                at = p - 1 - start
                a, b = context, context
                if ignore:
                    a = context[:at] + ref + context[at + 1 :]
                if ignore or ref == seq[p - 1]:
                    b = context[:at] + alt + context[at + 1 :]
                if annotation is not None and r.pos == 119:
                    a, b = (x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in (a, b))
                assert r.ref_kmers == brute_kmers(a, order) and r.alt_kmers == brute_kmers(b, order)
                assert r.ref_match == (ref == seq[p - 1]) and r.pos == p - 1


def test_effects(spark):
    df = spark.createDataFrame([(0, "c", 5, "A", "G", [0, 1], [2, 1])], "ord long, chrom string, pos long, ref string, alt string, ref_kmers array<int>, alt_kmers array<int>")
    row = variants.predict_effects(df, lambda k: (k == 2).sum(1)[:, None] + 1.0, ["x"]).first()
    assert (row.ref_x, row.alt_x, row.diff_x) == (1.0, 2.0, 1.0) and row.logodds_x == pytest.approx(np.log(2 + 1e-7))
