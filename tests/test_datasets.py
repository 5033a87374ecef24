from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from locusframe import datasets as D
from locusframe.operators.windows import Windows
from locusframe.sources import bam
from locusframe.sources.intervals import as_intervals

ROI = [("chr1", 15000, 25000, "a", "0", "+"), ("chr2", 15000, 25000, "b", "0", "-")]


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(3)
    return {c: "".join(rng.choice("ACGTacgt") for _ in range(30_000)) for c in ("chr1", "chr2")}


@pytest.fixture(scope="module")
def genome_df(spark, genome):
    return spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(genome.items())], "chrom string, seq string, ord long")


def test_edge_windows(spark):
    edge = as_intervals(spark, [("chr1", 0, 18, "x", "1", "+")])
    c = D.Cover.create_from_bed("x", edge, roi=edge, binsize=2, stepsize=2, flank=20, store_whole_genome=True)
    assert c.shape == (9, 42, 1, 1)
    sums = c[:].sum((1, 2, 3))
    assert sums.tolist() == [18.0] * 9
    part = D.Cover.create_from_bed("x", edge, roi=edge, binsize=2, stepsize=2, flank=2)
    assert part[:].sum((1, 2, 3)).tolist() == [4.0, *[6.0] * 7, 4.0] and part[0][0, :, 0, 0].tolist() == [1, 1, 1, 1, 0, 0]


def test_whole_and_partial_storage_agree(spark):
    rng = random.Random(4)
    rows = [("chr%d" % rng.randrange(1, 3), s, s + rng.randrange(1, 400), "n", str(rng.randrange(1, 9))) for s in (rng.randrange(14_000, 26_000) for _ in range(150))]
    f = as_intervals(spark, rows)
    for resolution in (1, 50):
        a, b = (D.Cover.create_from_bed("x", f, roi=ROI, binsize=200, stepsize=200, flank=150, resolution=resolution, mode="score", store_whole_genome=w, genomesize={"chr1": 30000, "chr2": 30000}) for w in (False, True))
        x, y = a[0:8], b[0:8]
        assert x.shape == (8, 500 // resolution, 1, 1) and (x == y).all() and x.sum() > 0
    whole = D.Cover.create_from_bed("x", f, roi=ROI, binsize=200, stepsize=200, resolution=None, mode="score", collapser="sum")
    fine = D.Cover.create_from_bed("x", f, roi=ROI, binsize=200, stepsize=200, resolution=1, mode="score")
    assert np.allclose(whole[:].reshape(-1), fine[:].sum((1, 2, 3)))


def test_interval_access_view_and_split(spark):
    rows = [("chr1", 15600, 15800, "s", "1"), ("chr1", 15800, 16000, "s", "5"), ("chr2", 15600, 15800, "s", "2"), ("chr2", 15800, 16000, "s", "4")]
    f = as_intervals(spark, rows)
    c = D.Cover.create_from_bed("x", f, roi=ROI, binsize=200, stepsize=200, mode="score", resolution=200)
    assert c[[0, 4, 50, 54]].reshape(-1).tolist() == [0, 5, 0, 4]
    whole = D.Cover.create_from_bed("x", f, roi=ROI, binsize=200, mode="score", store_whole_genome=True, genomesize={"chr1": 30000, "chr2": 30000})
    got = whole.interval("chr1", 15790, 15810)
    assert got[:, 0, 0].tolist() == [1.0] * 10 + [5.0] * 10
    assert whole.interval("chr1", 15790, 15810, "-")[:, 0, 0].tolist() == [5.0] * 10 + [1.0] * 10
    assert c.interval("chr1", 15790, 15810)[:, 0, 0].tolist() == [1.0] * 10 + [5.0] * 10
    train, test = D.split_train_test([c], "chr2")
    assert (len(train[0]), len(test[0])) == (50, 50) and test[0][4].item() == 4
    assert D.view(whole, [("chr1", 15600, 16400)]).shape == (4, 200, 1, 1)
    with pytest.raises(ValueError):
        D.subset(c)
    with pytest.raises(IndexError):
        c[None]
    with pytest.raises(ValueError):
        D.Cover.create_from_bed(3, f, roi=ROI, binsize=200)


def test_categories(spark):
    rows = [("chr1", 0, 10, "b", "1"), ("chr1", 5, 12, "a", "2")]
    c = D.Cover.create_from_bed("x", as_intervals(spark, rows), roi=[("chr1", 0, 20)], binsize=20, mode="name_category", resolution=5)
    assert c.conditions == ("a", "b") and c[0][0, :, 0].tolist() == [[0, 1], [1, 0], [1, 0], [0, 0]]


def test_reads_and_normalisers(spark):
    schema = "chrom string, reference_start long, reference_end long, is_reverse boolean, is_unmapped boolean, mapq int, is_paired boolean, is_proper_pair boolean, is_read2 boolean, next_chrom string, next_reference_start long, template_length long, query_length long, condition string"
    rng = random.Random(5)
    rows = [("chr1", s, s + 30, rng.random() < 0.5, False, 50, False, False, False, None, -1, 0, 30, "bam") for s in (rng.randrange(400) for _ in range(200))]
    reads = spark.createDataFrame(rows, schema)
    make = lambda **how: D.Cover.create_from_bam("x", None, roi=[("chr1", 0, 400)], conditions=["bam"], reads=reads, binsize=100, **how)
    x = make()[:]
    assert x.shape == (4, 100, 2, 1)
    places = np.zeros((500, 2))
    for r in rows:
        places[r[2] if r[3] else r[1], int(r[3])] += 1
    assert (x[..., 0].reshape(400, 2) == places[:400]).all()
    assert (make(resolution=None, stranded=False)[:].reshape(-1) == places[:400].reshape(4, -1).sum(1)).all()
    z = make(resolution=10, stranded=False, normalizer="zscore").cells().collect()
    y = places[:400].sum(1).reshape(40, 10).sum(1)
    want = (y - y.mean()) / np.sqrt(((y - y.mean()) ** 2).sum() / 39)
    assert all(r.value == pytest.approx(want[10 * r.idx + r.bin]) for r in z)


def zscored(y):
    sd = np.sqrt(((y - y.mean()) ** 2).sum() / (y.size - 1))
    return (y - y.mean()) / sd if sd else y * 0


def test_background_moves_with_the_normalisers(spark, tmp_path):
    bed = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "chrom string, start long, end long, name string, score string, strand string, ord long")
    features = bed([("chr1", 0, 5, "a", "2", "."), ("chr1", 22, 24, "b", "3", ".")])
    make = lambda **how: D.Cover.create_from_bed("x", features, conditions=["c"], genomesize={"chr1": 40}, mode="score", **how)
    y = np.zeros(40)
    y[:5], y[22:24] = 2, 3
    roi = [("chr1", 0, 40)]
    windows = dict(roi=roi, binsize=10, stepsize=10)
    seen = [0, 1, 2, 3]
    z = make(normalizer=["zscore"], store_whole_genome=True, **windows)
    assert z[seen].reshape(-1) == pytest.approx(zscored(y))
    assert z.interval("chr1", 3, 30)[:, 0, 0] == pytest.approx(zscored(y)[3:30])
    assert make(normalizer=["zscorelog"], store_whole_genome=True, **windows)[seen].reshape(-1) == pytest.approx(zscored(np.log1p(y)))
    parts = make(normalizer=["zscore"], **windows)
    got = parts[seen].reshape(-1)
    assert got == pytest.approx(zscored(y))
    assert parts.interval("chr1", 3, 30)[:, 0, 0] == pytest.approx(zscored(y)[3:30])
    assert {r.condition: r.background for r in parts.background().collect()} == {"c": pytest.approx(zscored(y)[-1])}
    by5 = np.array([y[i : i + 5].max() for i in range(0, 40, 5)])
    coarse = make(normalizer=["zscore"], resolution=5, **windows)
    assert coarse[seen].reshape(-1) == pytest.approx(zscored(by5))
    whole = make(normalizer=["zscore"], resolution=5, store_whole_genome=True, **windows)
    assert whole[seen].reshape(-1) == pytest.approx(zscored(by5))
    constant = D.Cover.create_from_bed("x", bed([("chr1", 0, 40, "a", "7", ".")]), conditions=["c"], genomesize={"chr1": 40}, mode="score", normalizer=["zscore"], **windows)
    assert (constant[seen] == 0).all()
    for cover, want in ((coarse, by5), (whole, by5)):
        rows = {}
        folder = tmp_path / str(id(cover))
        cover.export_to_bigwig(str(folder))
        for r in D.read_bigwig(spark, str(next(folder.iterdir()))).collect():
            rows.update({p: r.value for p in range(r.start, r.end)})
        assert [rows[p] for p in range(40)] == pytest.approx(np.repeat(zscored(want), 5), rel=1e-5)


def test_arrays_become_covers(spark):
    w = Windows.create_from_file(as_intervals(spark, ROI), 200, 200)
    a = np.random.default_rng(1).integers(0, 9, (100, 4, 2)).astype(float)
    c = D.Cover.create_from_array("x", a[:, :, :1], w, conditions=["u"])
    got = c[:10]
    assert c.resolution == 50 and (got[:, :, 0, 0] == a[:10, :, 0]).all()
    with pytest.raises(ValueError):
        D.Cover.create_from_array("x", a[:5], w)
    with pytest.raises(ValueError):
        D.Cover.create_from_array("x", np.zeros((394, 4)), Windows.create_from_file(as_intervals(spark, ROI), 200, 50), store_whole_genome=True)


def one_hot(seq):
    return np.array([[c == x for x in "ACGT"] for c in seq.upper()], float)


def test_sequences(spark, genome, genome_df):
    b = D.Bioseq.create_from_refgenome("dna", genome_df, roi=ROI, binsize=200, stepsize=200)
    assert b.shape == (100, 200, 1, 4)
    x = b[[0, 50, -1]]
    turn = lambda s: s[::-1].upper().translate(str.maketrans("ACGT", "TGCA"))
    for got, want in zip(x, (genome["chr1"][15000:15200], turn(genome["chr2"][15000:15200]), turn(genome["chr2"][24800:25000]))):
        assert (got[:, 0] == one_hot(want)).all()
    second = D.Bioseq.create_from_refgenome("dna", genome_df, roi=ROI, binsize=200, stepsize=200, order=2)
    assert second.shape == (100, 199, 1, 16) and second[3].sum() == 199
    edge = D.Bioseq.create_from_refgenome("dna", genome_df, roi=[("chr1", 0, 2), ("chr1", 29998, 30000)], binsize=2, flank=20)
    assert edge[:].sum((1, 2, 3)).tolist() == [22.0, 22.0] and edge[0][0, 22:].sum() == 0
    whole = D.Bioseq.create_from_refgenome("dna", genome_df, store_whole_genome=True)
    assert whole.interval("chr1", 10, 30) == genome["chr1"][10:30]
    with pytest.raises(ValueError):
        b.interval("chr1", 10, 30)
    with pytest.raises(ValueError):
        D.Bioseq.create_from_refgenome("dna", genome_df)


def test_sequences_as_regions(spark):
    df = spark.createDataFrame([("p1", "ACDEF", 0), ("p2", "MKV", 1)], "chrom string, seq string, ord long")
    b = D.Bioseq.create_from_seq("p", df, "protein", fixedlen=4)
    assert b.shape == (2, 4, 1, 20) and b[:].sum((1, 2, 3)).tolist() == [4, 3]


def test_variants(spark, genome, genome_df):
    seq = genome["chr2"].upper()
    rows = [(i, "chr2", p, f"v{i}", seq[p - 1], "A" if seq[p - 1] != "A" else "C") for i, p in enumerate((60, 120, 180, 2))]
    v = spark.createDataFrame(rows, "ord long, chrom string, pos long, name string, ref string, alt string")
    s = D.VariantStreamer(D.Bioseq.create_from_refgenome("dna", genome_df, store_whole_genome=True), v, 10)
    assert s.count() == 3
    out = s.predict(lambda k: np.stack([(k == 0).sum(1) + 1.0], 1), ["a"]).collect()
    assert len(out) == 3 and all(abs(r.diff_a) == 1 for r in out)
    with pytest.raises(ValueError):
        D.VariantStreamer(D.Bioseq.create_from_refgenome("dna", genome_df, roi=ROI, binsize=200), v, 10)


def test_wrappers(spark):
    a = np.random.default_rng(2).normal(size=(6, 5, 2, 3))
    a[0, 0, 0, 0] = np.nan
    x = D.Array("x", a, ["a", "b", "c"])
    assert np.allclose(D.NanToNumConverter(x)[:], np.nan_to_num(a)) and len(x) == 6 and x.conditions == ["a", "b", "c"]
    clean = D.NanToNumConverter(x)
    assert np.allclose(D.ReduceDim(clean)[:], np.nan_to_num(a).sum((1, 2))) and D.ReduceDim(clean).shape == (6, 3)
    assert np.allclose(D.ReduceDim(clean, "max", 2)[2:4], np.nan_to_num(a).max(2)[2:4])
    assert np.allclose(D.Transpose(clean, (0, 3, 1, 2))[:], np.nan_to_num(a).transpose(0, 3, 1, 2))
    assert D.SqueezeDim(D.Array("y", np.zeros((4, 1, 3)))).shape == (4, 3) and D.Array("z", [1, 2]).shape == (2, 1)
    for w in (D.RandomOrientation(clean), D.RandomShift(clean, 2), D.RandomSignalScale(clean, 0.1)):
        assert w[:].shape == a.shape
    for bad in (lambda: D.Array("x", a, ["a"]), lambda: D.ReduceDim(x, "nothing"), lambda: D.Array(1, a), lambda: D.Transpose(x, (1, 0, 2, 3))):
        with pytest.raises(ValueError):
            bad()


def test_batches(spark):
    a, y = D.Array("a", np.arange(14.0).reshape(7, 2)), D.Array("y", np.arange(7.0))
    b = D.Batches([a], [y], batch_size=3, shuffle_seed=1)
    assert len(b) == 3
    first = [(i[0].tolist(), o[0].reshape(-1).tolist()) for i, o in b]
    assert [o for _, o in first] == [[0, 1, 2], [3, 4, 5], [6]]
    again = [v for _, o in b for v in o[0].reshape(-1)]
    assert sorted(again) == list(range(7)) and again != list(range(7))
    assert set(next(iter(D.Batches({"a": a}, {"y": y}, as_dict=True)))[0]) == {"a"}
    with pytest.raises(ValueError):
        D.Batches([a], [D.Array("z", [1.0])])


def test_cover_from_files(spark, tmp_path):
    (tmp_path / "s.bedgraph").write_text("chr1\t15800\t16000\t.5\n")
    (tmp_path / "roi.bed").write_text("chr1\t15000\t25000\n")
    c = D.Cover.create_from_bed("x", str(tmp_path / "s.bedgraph"), roi=str(tmp_path / "roi.bed"), binsize=200, resolution=200, mode="bedgraph", genomesize={"chr1": 30000})
    assert c.conditions == ("s",) and c[4].item() == 0.5
    c.export_to_bigwig(str(tmp_path))
    back = D.Cover.create_from_bigwig("x", str(tmp_path / "x.s.bigwig"), roi=pd.DataFrame({"chrom": ["chr1"], "start": [15000], "end": [25000]}), binsize=200, resolution=200)
    assert back[4].item() == 0.5 and back[:].sum() == 0.5


def test_signal_is_read_near_windows_and_kept(spark, tmp_path):
    from locusframe.sources import bigwig

    n = 3 << 20
    path = tmp_path / "s.bw"
    with open(path, "wb") as f:
        bigwig.write_bigwig(f, [("chr1", n)], (("chr1", i, i + 512, float(i // 512 % 5)) for i in range(0, n, 512)), items=64)
    make = lambda **how: D.Cover.create_from_bigwig("x", str(path), roi=[("chr1", 1024, 5120)], binsize=1024, resolution=512, **how)
    cover = make()
    assert cover.signal.count() < n // 512 // 2 and cover[:].reshape(-1).tolist() == [2, 3, 4, 0, 1, 2, 3, 4]
    far = cover.view([("chr1", n - 1024, n)])
    want = [float((n // 512 - k) % 5) for k in (2, 1)]
    assert far[:].reshape(-1).tolist() == want
    folder = str(tmp_path / "kept")
    kept = make(cache=folder, datatags=["a", "b"])
    assert (kept[:] == cover[:]).all() and kept.view([("chr1", n - 1024, n)])[:].reshape(-1).tolist() == want
    tables = lambda: sorted((tmp_path / "kept" / "datasets" / "a" / "b").iterdir())
    first = tables()
    written = (first[0] / "_SUCCESS").stat().st_mtime_ns
    make(cache=folder, datatags=["a", "b"])
    assert tables() == first and len(first) == 1 and (first[0] / "_SUCCESS").stat().st_mtime_ns == written
    make(cache=folder, datatags=["a", "b"], overwrite=True)
    assert tables() == first and (first[0] / "_SUCCESS").stat().st_mtime_ns != written
    make(cache=folder, datatags=["a", "b"], nan_to_num=False)
    assert len(tables()) == 2
    w = Windows.create_from_file(as_intervals(spark, [("chr1", 0, 20)]), 10, 10)
    arrays = [D.Cover.create_from_array("y", np.full((2, 1), v), w, cache=folder) for v in (1.0, 2.0, 1.0)]
    assert [a[:].reshape(-1).tolist() for a in arrays] == [[1, 1], [2, 2], [1, 1]]
    assert len(list((tmp_path / "kept" / "datasets" / "y").iterdir())) == 2


def test_parameters_are_known(spark, genome_df):
    f = as_intervals(spark, [("chr1", 0, 18)])
    with pytest.raises(TypeError, match="resolutoin"):
        D.Cover.create_from_bed("x", f, roi=f, binsize=2, resolutoin=2)
    with pytest.raises(TypeError):
        D.Bioseq.create_from_refgenome("x", genome_df, roi=ROI, flanks=2)
    with pytest.raises(ValueError, match="cache"):
        D.Cover.create_from_bed("x", f, roi=f, binsize=2, cache=True)
    D.Cover.create_from_bed("x", f, roi=f, binsize=2, storage="sparse", dtype="float32", verbose=True)
    reads = spark.createDataFrame([], bam.FILE_SCHEMA + ", condition string")
    with pytest.warns(UserWarning, match="template_extension"):
        D.Cover.create_from_bam("x", None, roi=f, conditions=["a"], reads=reads, binsize=2, template_extension=5)
