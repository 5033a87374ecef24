from __future__ import annotations

import random

import numpy as np
import pytest

from locusframe.operators import normalize, track
from locusframe.operators.windows import Windows
from locusframe.sources.intervals import as_intervals

LENGTH = 400


def painted(rows, length=LENGTH):
    out = np.zeros(length)
    for _, s, e, _, v, *_ in rows:
        out[s:e] = float(v)
    return out


@pytest.fixture(scope="module")
def features():
    rng = random.Random(1)
    return [("c", s, min(LENGTH, s + rng.randrange(1, 60)), "n%d" % (i % 3), str(rng.randrange(-5, 9))) for i, s in enumerate(rng.randrange(LENGTH) for _ in range(50))]


@pytest.mark.parametrize("bin_size", [1, 16, 1024])
def test_last_row_wins(spark, features, bin_size):
    runs = track.feature_track(as_intervals(spark, features), "score", bin_size=bin_size).collect()
    got = np.zeros(LENGTH)
    seen = np.zeros(LENGTH, int)
    for r in runs:
        got[r.start : r.end] = r.value
        seen[r.start : r.end] += 1
    assert (got == painted(features)).all() and seen.max() == 1


@pytest.mark.parametrize("how", ["sum", "mean", "max"])
@pytest.mark.parametrize("resolution,tail", [(1, "cycle"), (10, "cycle"), (7, "cycle"), (7, "zero"), (50, "cycle"), (None, "cycle")])
def test_collapse_matches_brute_force(spark, features, how, resolution, tail):
    regions = as_intervals(spark, [("c", 3, 33), ("c", 100, 130), ("c", 355, 385)])
    w = Windows.create_from_file(regions, 30)
    runs = track.feature_track(as_intervals(spark, features), "score")
    got = {(r.idx, r.bin): r.value for r in track.collapse(track.window_runs(w.df, runs), resolution, how, tail=tail).collect()}
    base, f = painted(features), {"sum": np.sum, "mean": np.mean, "max": np.max}[how]
    for i, s in enumerate((3, 100, 355)):
        x = base[s : s + 30]
        size = resolution or 30
        whole = -(-30 // size) * size
        x = np.resize(x, whole) if tail == "cycle" else np.r_[x, np.zeros(whole - 30)]
        for b, part in enumerate(x.reshape(-1, size)):
            assert got.get((i, b), 0.0) == pytest.approx(f(part))


def test_custom_collapser(spark, features):
    w = Windows.create_from_file(as_intervals(spark, [("c", 0, 400)]), 40)
    runs = track.feature_track(as_intervals(spark, features), "score")
    got = {r.idx: r.value for r in track.collapse(track.window_runs(w.df, runs), None, lambda a: np.median(a, 0)).collect()}
    base = painted(features)
    assert all(got.get(i, 0.0) == pytest.approx(np.median(base[40 * i : 40 * i + 40])) for i in range(10))
    with pytest.raises(ValueError):
        track.collapse(None, 1, "median")


def read(start, end, reverse=False, **more):
    row = dict(chrom="c", reference_start=start, reference_end=end, is_reverse=reverse, is_unmapped=False, mapq=30, is_paired=False, is_proper_pair=False, is_read2=False, next_chrom=None, next_reference_start=-1, template_length=0, query_length=end - start)
    return {**row, **more}


READ_SCHEMA = "chrom string, reference_start long, reference_end long, is_reverse boolean, is_unmapped boolean, mapq int, is_paired boolean, is_proper_pair boolean, is_read2 boolean, next_chrom string, next_reference_start long, template_length long, query_length long"


def test_read_positions(spark):
    pair = dict(is_paired=True, is_proper_pair=True, next_chrom="c")
    rows = [read(10, 60), read(10, 60), read(20, 70, True), read(1, 2, is_unmapped=True), read(1, 2, mapq=3), read(100, 150, False, **pair, next_reference_start=300, template_length=250), read(300, 350, True, **pair, is_read2=True, next_reference_start=100, template_length=-250), read(5, 6, is_paired=True), read(5, 6, **{**pair, "next_chrom": "d"})]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in READ_SCHEMA.split(", ")) for r in rows], READ_SCHEMA)
    got = lambda **how: sorted((r.start, r.strand, r.value) for r in track.read_track(df, min_mapq=10, **how).collect())
    assert got() == [(10, 0, 2.0), (70, 1, 1.0), (100, 0, 1.0), (350, 1, 1.0)]
    assert got(pairedend="midpoint", stranded=False) == [(10, 0, 2.0), (70, 0, 1.0), (225, 0, 1.0)]
    sizes = spark.createDataFrame([("c", 99)], "chrom string, length long")
    assert got(sizes=sizes) == [(10, 0, 2.0), (70, 1, 1.0)]


def test_minus_windows_turn_around(spark):
    runs = spark.createDataFrame([("c", 0, 1, 0, "x", 5.0), ("c", 3, 4, 1, "x", 7.0)], "chrom string, start long, end long, strand int, condition string, value double")
    w = Windows.create_from_file(as_intervals(spark, [("c", 0, 10, "", "", "-")]), 10)
    cells = track.oriented(track.collapse(track.window_runs(w.df, runs), 1, "sum", True), w.df, 1, True)
    assert {(r.bin, r.strand, r.value) for r in cells.collect()} == {(9, 1, 5.0), (6, 0, 7.0)}


def test_scores_and_categories(spark):
    scored = [("chr1", 15600, 15800, "state1", "1"), ("chr1", 15800, 16000, "state2", "5"), ("chr2", 15600, 15800, "state1", "2"), ("chr2", 15800, 16000, "state2", "4")]
    f = as_intervals(spark, scored)
    assert track.categories(f, "score_category") == ["1", "2", "4", "5"] and track.categories(f, "name_category") == ["state1", "state2"]
    w = Windows.create_from_file(as_intervals(spark, [("chr1", 15000, 25000), ("chr2", 15000, 25000)]), 200)
    cells = track.collapse(track.window_runs(w.df, track.feature_track(f, "score")), 200, "max")
    assert {r.idx: r.value for r in cells.collect()} == {3: 1.0, 4: 5.0, 53: 2.0, 54: 4.0}
    with pytest.raises(ValueError):
        track.check_scores(as_intervals(spark, [("c", 0, 1, "a", ".")]), "score")


def test_minoverlap(spark):
    runs = track.feature_track(as_intervals(spark, [("chr1", 1451, 1500)]))
    w = Windows.create_from_file(as_intervals(spark, [("chr1", 1300 + 50 * i, 1500 + 50 * i) for i in range(4)]), 200)
    assert track.with_minoverlap(w.df, runs, None).count() == 4
    assert track.with_minoverlap(w.df, runs, 0.2).count() == 4 and track.with_minoverlap(w.df, runs, 0.5).count() == 0


def test_normalisers(spark):
    sizes = spark.createDataFrame([("a", 150), ("b", 300)], "chrom string, length long")
    make = lambda a, b: normalize.Signal.of(spark.createDataFrame([("a", 0, 150, 0, "x", a), ("b", 0, 300, 0, "x", b)], "chrom string, start long, end long, strand int, condition string, value double"), sizes)
    values = lambda s: [round(r.value, 5) for r in s.runs.orderBy("chrom").collect()]
    assert values(normalize.normalize(make(1.0, -1.0), ["zscore"])) == pytest.approx([1.41264, -0.70632], abs=1e-5)
    dense = np.r_[np.full(150, np.log(11.0)), np.full(300, np.log(2.0))]
    want = (dense - dense.mean()) / np.sqrt(((dense - dense.mean()) ** 2).sum() / 449)
    assert values(normalize.normalize(make(10.0, 1.0), ["zscorelog"])) == pytest.approx([want[0], want[-1]], abs=1e-5)
    binned = normalize.Signal.of(spark.createDataFrame([("a", 0, 3, 0, "x", 10.0), ("b", 0, 6, 0, "x", 1.0)], "chrom string, start long, end long, strand int, condition string, value double"), sizes)
    per = 30 * 1000 / 50 + 6 * 1000 / 50
    assert values(normalize.normalize(binned, ["tpm"], 50)) == pytest.approx([10 * 1000 / 50 * 1e6 / per, 1000 / 50 * 1e6 / per])
    with pytest.raises(ValueError):
        normalize.normalizer("nothing")


def test_background_moves_with_the_signal(spark):
    sizes = spark.createDataFrame([("a", 100)], "chrom string, length long")
    runs = spark.createDataFrame([("a", 0, 10, 0, "x", 5.0), ("a", 20, 50, 0, "x", 2.0)], "chrom string, start long, end long, strand int, condition string, value double")
    x = np.zeros(100)
    x[:10], x[20:50] = 5, 2
    z = (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).sum() / 99)
    z = (z - z.mean()) / np.sqrt(((z - z.mean()) ** 2).sum() / 99)
    got = normalize.normalize(normalize.Signal.of(runs, sizes), ["zscore", "zscore"])
    assert sorted(round(r.value, 9) for r in got.runs.collect()) == sorted(round(v, 9) for v in (z[0], z[20]))
    assert got.zero.first().background == pytest.approx(z[10])
    y = np.minimum(x, np.percentile(x, 92))
    trimmed = normalize.percentile_trim(normalize.Signal.of(runs, sizes), 92)
    assert {r.start: r.value for r in trimmed.runs.collect()} == pytest.approx({0: y[0], 20: y[20]})
    kept = normalize.ZScore()
    kept(normalize.Signal.of(runs, sizes))
    again = kept(normalize.Signal.of(runs.withColumn("value", runs.value * 2), sizes))
    assert max(r.value for r in again.runs.collect()) == pytest.approx((10 - x.mean()) / np.sqrt(((x - x.mean()) ** 2).sum() / 99))
