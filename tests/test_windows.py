from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import access, rangejoin
from locusframe.operators.windows import Windows, genome_size, parse_label, tile, trim_to_multiple
from locusframe.sources.intervals import as_intervals


def brute_tile(start, end, binsize, step, padding):
    val = end - start - binsize + step if step <= binsize else end - start
    n = val // step
    out = [(start + k * step, start + k * step + binsize) for k in range(n)]
    return out + [(start + n * step, end)] * bool(padding and val % step > 0)


def regions(spark, rows):
    return as_intervals(spark, rows)


SAMPLE = [("chr1", 15000, 25000, "a", "0", "+"), ("chr2", 15000, 25000, "b", "0", "-")]
EQUAL = [("chr1", 15000 + 200 * i, 15200 + 200 * i) for i in range(4)]


@pytest.mark.parametrize("rows,binsize,step,padding,count", [(SAMPLE, 200, 200, True, 100), (SAMPLE, 200, 50, True, 394), (SAMPLE, 3000, 3000, True, 8), (SAMPLE, 3000, 3000, False, 6), (EQUAL, 180, 20, True, 8), (EQUAL, 210, 20, False, 0), (EQUAL, 210, 20, True, 4), ([("chr1", 600, 2000)], 200, 200, True, 7)])
def test_golden_counts(spark, rows, binsize, step, padding, count):
    assert len(Windows.create_from_file(regions(spark, rows), binsize, step, zero_padding=padding)) == count


def test_golden_last_windows(spark):
    for padding, last in ((True, (24000, 25000)), (False, (21000, 24000))):
        row = Windows.create_from_file(regions(spark, SAMPLE), 3000, 3000, zero_padding=padding).at(-1).first()
        assert (row.chrom, row.start, row.end, row.strand) == ("chr2", *last, "-")


def test_tiling_matches_brute_force(spark):
    rows = [("c", s, s + n) for s, n in itertools.product((0, 7, 350), (1, 10, 49, 50, 110, 200, 350))]
    df = regions(spark, rows)
    for binsize, step, padding in itertools.product((1, 10, 50, 200), (1, 7, 50, 200), (True, False)):
        want = sorted((i, *w) for i, (_, s, e) in enumerate(rows) for w in brute_tile(s, e, binsize, step, padding))
        order = df.select("ord", "start", "end").collect()
        place = {(r.ord): next(i for i, x in enumerate(rows) if x[1:] == (r.start, r.end)) for r in order}
        got = sorted((place[r.ord], r.start, r.end) for r in tile(df, binsize, step, padding).collect())
        assert got == want, (binsize, step, padding)


def test_numbers_follow_file_order(spark):
    rng = random.Random(1)
    rows = [("c%d" % rng.randrange(3), s, s + rng.randrange(1, 90)) for s in rng.sample(range(1000), 60)]
    w = Windows.create_from_file(regions(spark, rows).repartition(5), 20, 10)
    want = [(c, *x) for c, s, e in rows for x in brute_tile(s, e, 20, 10, True)]
    got = [(r.chrom, r.start, r.end) for r in w.df.orderBy("idx").collect()]
    assert got == want and [r.idx for r in w.df.orderBy("idx").collect()] == list(range(len(want)))


def test_region_filter_bounds(spark):
    w = Windows.create_from_file(regions(spark, [("chr1", 0, 18)]), 2)
    for (s, e), n in {(5, 10): 3, (5, 11): 4, (6, 10): 2, (6, 11): 3, (20, 30): 0}.items():
        assert w.where(start=s, end=e).count() == n
    assert w.where(include="chr2").count() == 0 and w.where(exclude=["chr1"]).count() == 0
    kept = w.filter_by_region(start=6, end=11)
    assert [r.idx for r in kept.df.orderBy("idx").collect()] == [0, 1, 2]


def test_flank_access_and_union(spark):
    w = Windows.create_from_file(regions(spark, SAMPLE), 200, flank=16000)
    row = w.at(0).first()
    assert (row.start, row.end) == (0, 31200)
    assert len(w.at(slice(0, 10, 3)).collect()) == 4
    with pytest.raises(IndexError):
        w.at("x")
    both = w.add(Windows.create_from_file(regions(spark, EQUAL), 100))
    assert len(both) == 108 and both.at(100).first().chrom == "chr1"
    assert Windows.create_from_region(spark, "c", 5, 5, binsize=1).df.count() == 0


def test_parameters():
    for how in ({"binsize": 0}, {"stepsize": -1}, {"flank": -1}, {"flank": 1.5}):
        with pytest.raises(ValueError):
            Windows(None, **how)


def test_shuffle_is_a_permutation(spark):
    a = Windows.create_from_file(regions(spark, SAMPLE), 200, random_state=1)
    b = Windows.create_from_file(regions(spark, SAMPLE), 200)
    rows = [(r.idx, r.chrom, r.start) for r in a.df.orderBy("idx").collect()]
    assert [r[0] for r in rows] == list(range(100))
    assert rows != [(r.idx, r.chrom, r.start) for r in b.df.orderBy("idx").collect()]


def test_whole_genome_check(spark):
    w = Windows.create_from_file(regions(spark, SAMPLE), 200)
    w.check(50, True)
    with pytest.raises(ValueError):
        w.check(30, True)
    with pytest.raises(ValueError):
        Windows.create_from_file(regions(spark, [("c", 3, 203)]), 200).check(50, True)


def test_labels_trim_and_sizes(spark):
    df = spark.createDataFrame([("chr1:5-10",), ("chr1:-5-10",), ("chr1",), ("x:1-y",)], "s string").select("s", parse_label(F.col("s")).alias("p"))
    got = {r.s: tuple(r.p) for r in df.collect()}
    assert got == {"chr1:5-10": ("chr1", 5, 10), "chr1:-5-10": ("chr1", -5, 10), "chr1": ("chr1", None, None), "x:1-y": (None, None, None)}
    row = trim_to_multiple(regions(spark, [("c", 13, 89)]), 10).first()
    assert (row.start, row.end, row.score) == (20, 80, "0")
    assert {(r.chrom, r.length) for r in genome_size(regions(spark, SAMPLE)).collect()} == {("chr1", 25000), ("chr2", 25000)}


def brute_pairs(a, b):
    return sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


@pytest.mark.parametrize("bin_size", [1, 7, 64, None])
def test_overlap_joins_match_brute_force(spark, bin_size):
    rng = random.Random(2)
    make = lambda n: [("c%d" % rng.randrange(2), s, s + rng.randrange(0, 60)) for s in (rng.randrange(-20, 400) for _ in range(n))]
    a, b = make(60), make(80)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "k long, chrom string, start long, end long")
    right = spark.createDataFrame([(i, *x, "-" if i % 3 else "+") for i, x in enumerate(b)], "j long, chrom string, start long, end long, strand string")
    want = [p for p in brute_pairs(a, b) if a[p[0]][1] < a[p[0]][2] and b[p[1]][1] < b[p[1]][2]]
    assert sorted((r.k, r.r_j) for r in rangejoin.overlap_join(left, right, bin_size).collect()) == want
    hit = {i for i, _ in want}
    assert {r.k for r in rangejoin.overlap_semi(left, right, "k", bin_size).collect()} == hit
    assert {r.k for r in rangejoin.overlap_semi(left, right, "k", bin_size, anti=True).collect()} == set(range(60)) - hit
    assert rangejoin.overlap_left(left, right, "k", bin_size).count() == len(want) + 60 - len(hit)
    minus = {i for i, j in want if j % 3}
    assert {r.k for r in rangejoin.annotate_strand(left, right, "k", bin_size).where("annotated = '-'").collect()} == minus


def test_merge_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [("c", s, s + rng.randrange(1, 30)) for s in (rng.randrange(2000) for _ in range(80))]
    want = []
    for _, s, e in sorted(rows):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    for size in (16, 1 << 20):
        got = [[r.start, r.end] for r in rangejoin.merge_intervals(regions(spark, rows), bin_size=size).orderBy("start").collect()]
        assert got == want


def test_subsets(spark):
    df = regions(spark, SAMPLE)
    with pytest.raises(ValueError):
        access.subset(df)
    train, test = access.split_train_test([df, df], "chr2")
    assert [x.count() for x in (*train, *test)] == [1, 1, 1, 1] and test[0].first().chrom == "chr2"


def test_merging_and_as_of_in_small_bins(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), s, s + rng.choice([1, 3, 8, 90])) for s in (rng.randrange(2000) for _ in range(150))]
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    for distance in (0, 4):
        want = []
        for c, s, e in sorted(rows):
            if want and want[-1][0] == c and s <= want[-1][2] + distance:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([c, s, e])
        for size in (7, 64, 1 << 20):
            got = rangejoin.merge_intervals(df, distance, size).collect()
            assert sorted([r.chrom, r.start, r.end] for r in got) == want
    asked = spark.createDataFrame([(i, rng.choice("abc"), rng.randrange(2100)) for i in range(200)], "ord long, chrom string, start long")
    for size in (5, 1 << 16):
        found = rangejoin.nearest_before(asked, df, "ord", F.col("start"), size).collect()
        assert len(found) == 200
        for r in found:
            before = [s for c, s, _ in rows if c == r.chrom and s <= r.start]
            assert r.value == (str(max(before)) if before else None)


def test_bedgraph_rows_of_two_strands(spark):
    import random

    from locusframe.sources import sinks

    rng = random.Random(4)
    rows, value = [], {}
    for c in "xy":
        for strand in (0, 1):
            at = 0
            while at < 300:
                s = at + rng.randrange(20)
                at = s + rng.randint(1, 25)
                rows.append(("chr1", s, at, strand, c, rng.choice([0.1, 0.7, 2.0, -0.7])))
    for _, s, e, _, c, v in rows:
        for p in range(s, e):
            value[c, p] = value.get((c, p), 0.0) + v
    track_ = spark.createDataFrame(rows, "chrom string, start long, end long, strand int, condition string, value double")
    for size in (16, 1 << 20):
        got = {}
        for r in sinks.bedgraph_rows(track_, size).collect():
            for p in range(r.start, r.end):
                assert (r.condition, p) not in got
                got[r.condition, p] = r.value
        assert got == {k: v for k, v in value.items() if v != 0}
