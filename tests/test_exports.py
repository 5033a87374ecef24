"""Scorers, exporters, variant sinks, attributions and the trim command."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest

from locusframe import datasets as D
from locusframe import trim
from locusframe.operators import scoring, tensor
from locusframe.operators.windows import Windows
from locusframe.sources import bigwig, sinks
from locusframe.sources.intervals import as_intervals

PREDICTED = "idx long, bin long, condition string, value double"


def text(folder):
    return "".join((gzip.open(p, "rt").read() if p.suffix == ".gz" else p.read_text()) for p in sorted(folder.glob("part*")))


@pytest.fixture(scope="module")
def layers(spark):
    rows = [(i, 0, c, (i * 7 + k * 3) % 10 / 10) for i in range(12) for k, c in enumerate("ab")]
    labels = [(i, 0, c, float((i + k) % 2)) for i in range(12) for k, c in enumerate("ab")]
    return rows, labels, spark.createDataFrame(rows, PREDICTED), spark.createDataFrame(labels, PREDICTED)


def test_scorer(spark, layers, tmp_path):
    rows, labels, predicted, outputs = layers
    want = {c: np.mean([(p[3] - y[3]) ** 2 for p, y in zip(rows, labels) if p[2] == c]) for c in "ab"}
    one = scoring.Scorer("mse", "mse", exporter=sinks.ExportJson(row_names=["r1"], annot={"t": [1, 2]}))
    got = one.score({"out": predicted}, {"out": outputs}, model="m", folder=str(tmp_path), datatags=["test", "set"])
    assert {(r.model, r.layer, r.condition): r.value for r in got.collect()} == {("m", "out", c): pytest.approx(v) for c, v in want.items()}
    lines = [json.loads(x) for x in text(tmp_path / "evaluation" / "m" / "test-set" / "mse.json").splitlines()]
    assert {x["key"]: x["value"] for x in lines} == {"a": pytest.approx(want["a"]), "b": pytest.approx(want["b"]), "row_names": ["r1"], "annot": {"t": [1, 2]}}
    own = scoring.Scorer("top", lambda p: p.max(), percondition=False).score({"out": predicted})
    assert [tuple(r) for r in own.collect()] == [("model", "out", "across", max(r[3] for r in rows))]
    held = scoring.Scorer("mae", "mae", exporter=sinks.ExportTsv(annot={"kind": ["x"]}), immediate_export=False, subdir="tables")
    held.export(str(tmp_path), "all")
    assert not (tmp_path / "tables").exists()
    for model in ("m1", "m2"):
        held.score({"out": predicted}, {"out": outputs}, model=model)
    held.export(str(tmp_path), "all")
    head, values = text(tmp_path / "tables" / "all" / "mae.tsv").splitlines()
    assert head.split("\t") == ["m1-out-a", "m1-out-b", "m2-out-a", "m2-out-b", "annot.kind"]
    assert float(values.split("\t")[0]) == pytest.approx(np.mean([abs(p[3] - y[3]) for p, y in zip(rows, labels) if p[2] == "a"])) and values.endswith("\tx")
    numbered = predicted.selectExpr("idx", "bin", "ascii(condition) - 97 as condition", "value")
    assert {r.condition for r in scoring.Scorer("p", conditions=["u", "v"]).score({"out": numbered}).collect()} == {"u", "v"}
    with pytest.raises(ValueError):
        scoring.Scorer("x", "nothing")
    with pytest.raises(ValueError):
        scoring.Scorer("x").score({"out": predicted}, {"out": outputs})
    with pytest.raises(ValueError):
        scoring.Scorer("x", "auc").score({"out": predicted})


def test_prediction_exports(spark, tmp_path):
    w = Windows.create_from_file(as_intervals(spark, [("chr1", 0, 40)]), 20, 10)  # windows overlap: the last one counts
    rows = [(i, b, "c", 10.0 * i + b + 1) for i in range(3) for b in range(4)]
    results = spark.createDataFrame(rows, PREDICTED)
    sinks.ExportBigwig(w.df, 5)(str(tmp_path), "pred", results, ["condition"])
    got = np.zeros(40)
    for r in bigwig.read_bigwig(spark, str(tmp_path / "pred.c.bigwig")).collect():
        got[r.start : r.end] = r.value
    want = np.zeros(40)
    for i, b, _, v in rows:
        want[10 * i + 5 * b : 10 * i + 5 * b + 5] = v
    assert got.tolist() == want.tolist()
    sinks.ExportBed(w.df, 5)(str(tmp_path), "pred", results, ["condition"])
    assert len(text(tmp_path / "pred.bed" / "condition=c").splitlines()) == 12
    wide = sinks.ExportTsv().rows(results, ["condition"]).orderBy("idx", "bin").collect()
    assert [(r.idx, r.bin, r.c) for r in wide] == [(i, b, v) for i, b, _, v in rows]


def test_variant_files(spark, tmp_path):
    genome = spark.createDataFrame([("chr1", "ACGTACGTACGTACGTACGT", 0)], "chrom string, seq string, ord long")
    v = spark.createDataFrame([("chr1", 9, 10, "v1", 10, "C", "T", 0), ("chr1", 11, 12, "v2", 12, "T", "G", 1)], "chrom string, start long, end long, name string, pos long, ref string, alt string, ord long")
    s = D.VariantStreamer(D.Bioseq.create_from_refgenome("dna", genome, store_whole_genome=True), v, 4)
    model = lambda x: np.stack([x.sum(1) + 5, x.max(1) + 5], 1)
    held = s.write(model, ["one", "two"], str(tmp_path / "out"), condition_filter="^t")
    want = s.predict(model, ["one", "two"]).orderBy("ord").collect()
    assert [(r.name, r.ref_two, r.diff_two) for r in held.orderBy("ord").collect()] == [(r.name, r.ref_two, r.diff_two) for r in want] and "ref_one" not in held.columns
    assert spark.read.parquet(str(tmp_path / "out" / "scores")).count() == 2
    assert text(tmp_path / "out" / "snps.bed.gz").splitlines() == [f"chr1\t{r.pos}\t{r.pos + 1}\t{r.name}_{r.ref}>{r.alt}" for r in want]


def test_attributions(spark):
    x = spark.createDataFrame([(0, [1.0, 2.0], [3.0]), (1, [0.0, -1.0], [2.0])], "idx long, a array<double>, b array<double>")
    # f = a0 * a1 + b^2: along the way from 0 the mean gradients are near a1 / 2, a0 / 2 and b
    gradient = lambda held: [held[0][:, ::-1], 2 * held[1]]
    got = {r.idx: (r.a, r.b) for r in tensor.integrated_gradients(x, gradient, ["a", "b"]).collect()}
    half = 51 / 100
    assert got[0][0] == pytest.approx([2 * half, 2 * half]) and got[0][1] == pytest.approx([9 * 2 * half])
    assert got[1][0] == pytest.approx([0, 0]) and got[1][1] == pytest.approx([4 * 2 * half])
    features = as_intervals(spark, [("chr1", 4, 12, "f", "3", "+")])
    cover = D.Cover.create_from_bed("x", features, roi=[("chr1", 0, 20)], binsize=8, stepsize=4, mode="score", resolution=2, genomesize={"chr1": 20})
    weights = np.arange(1.0, 5.0)  # of a window's four bins
    (out,) = D.input_attribution([cover], lambda held: [np.broadcast_to(weights, held[0].shape)], "chr1", 5, 11)
    want = {}
    for start in range(0, 13, 4):
        for b, weight in enumerate(weights):
            for p in (start + 2 * b, start + 2 * b + 1):
                if 5 <= p < 11:
                    want[p] = max(want.get(p, 0), weight * (3.0 if 4 <= p < 12 else 0.0))
    assert {r.pos: r.value for r in out.collect()} == pytest.approx(want)


def test_trim_command(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t3\t27\tx\t7\t-\nchr1\t10\t20\nchr1\t11\t19\tz\n")
    trim.main([str(tmp_path / "a.bed"), str(tmp_path / "b.bed"), "-divby", "5"])
    assert text(tmp_path / "b.bed").splitlines() == ["chr1\t5\t25\tx\t7\t-", "chr1\t10\t20\t.\t0\t.", "chr1\t15\t15\tz\t0\t."]
