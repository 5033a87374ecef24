from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import scoring, tensor
from locusframe.sources import sinks

SHAPE = (5, 2, 3)


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(0).normal(size=(7, *SHAPE))


@pytest.fixture(scope="module")
def rows(spark, array):
    return spark.createDataFrame([(i, list(map(float, x.reshape(-1)))) for i, x in enumerate(array)], "idx long, values array<double>")


def back(df, shape):
    held = df.orderBy("idx").collect()
    return np.array([r["values"] for r in held]).reshape(len(held), *shape)


def test_reshapes(rows, array):
    assert (back(rows.withColumn("values", tensor.transpose(F.col("values"), SHAPE, (2, 0, 1))), (3, 5, 2)) == array.transpose(0, 3, 1, 2)).all()
    assert (back(rows.withColumn("values", tensor.flip(F.col("values"), SHAPE)), SHAPE) == array[:, ::-1, ::-1]).all()
    assert tensor.squeeze((4, 1, 3, 1)) == (4, 3) and tensor.squeeze((1, 1, 3), 1) == (1, 3)
    for call in (lambda: tensor.squeeze((4, 2), 1), lambda: tensor.transpose(F.col("x"), (2, 2), (0, 0))):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("how,f", [(None, np.sum), ("mean", np.mean), ("max", np.max), (np.median, np.median)])
def test_reductions(rows, array, how, f):
    got = {(r.idx, r.condition): r.value for r in tensor.reduce_dim(tensor.unstack(rows, SHAPE), how).collect()}
    assert all(got[i, c] == pytest.approx(f(array[i, :, :, c])) for i in range(7) for c in range(3))
    with pytest.raises(ValueError):
        tensor.reduce_dim(rows, "nothing")


def test_random_operators(rows, array):
    shifted = back(tensor.random_shift(rows, SHAPE, 2, 1), SHAPE)
    allowed = {r: np.concatenate([np.zeros((max(r, 0), 2, 3)), x[max(-r, 0) : 5 - max(r, 0)], np.zeros((max(-r, 0), 2, 3))]) for r in (-2, -1, 0, 1) for x in array[:1]}
    assert any((shifted[0] == v).all() for v in allowed.values())
    turned = back(tensor.random_orientation(rows, SHAPE, 1), SHAPE)
    assert all((t == a).all() or (t == a[::-1, ::-1]).all() for t, a in zip(turned, array))
    cells = tensor.random_scale(tensor.unstack(rows, SHAPE), 0.1, 1).collect()
    factors = {(r.idx, r.condition): r.value / array[r.idx, r.pos, r.strand, r.condition] for r in cells}
    assert all(0.9 <= v <= 1.1 for v in factors.values()) and len({round(v, 6) for v in factors.values()}) == 21


def test_nan_upsample_batches(spark, rows):
    got = spark.range(1).select(F.transform(F.array(*map(F.lit, [float("nan"), float("inf"), -float("inf"), 1.5])), tensor.nan_to_num).alias("x")).first().x
    assert got == np.nan_to_num([np.nan, np.inf, -np.inf, 1.5]).tolist()
    assert spark.range(1).select(tensor.upsample(F.array(F.lit(1), F.lit(2)), 2).alias("x")).first().x == [1, 1, 2, 2]
    assert sorted(r.batch for r in tensor.batches(rows, 3).collect()) == [0, 0, 0, 1, 1, 1, 2]
    assert sorted(r.batch for r in tensor.batches(rows, 3, shuffle_seed=1).collect()) == [0, 0, 0, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        tensor.zipped({"a": rows, "b": rows.limit(3)})


def brute_auc(y, p):
    pos, neg = p[y > 0], p[y == 0]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


def test_rank_scores(spark):
    rng = np.random.default_rng(1)
    y, p, c = rng.integers(0, 2, 400), rng.integers(0, 60, 400) / 7, rng.integers(0, 2, 400)
    df = spark.createDataFrame([(f"c{k}", int(a), float(b)) for k, a, b in zip(c, y, p)], "condition string, y int, p double")
    got = {r.condition: r.value for r in scoring.score(df, "auc").collect()}
    ap = {r.condition: r.value for r in scoring.score(df, "auprc").collect()}
    for k in (0, 1):
        yy, pp = y[c == k], p[c == k]
        assert got[f"c{k}"] == pytest.approx(brute_auc(yy, pp))
        cuts = sorted(set(pp), reverse=True)
        tp = np.array([(yy[pp >= t] > 0).sum() for t in cuts])
        n = np.array([(pp >= t).sum() for t in cuts])
        recall = tp / tp[-1]
        assert ap[f"c{k}"] == pytest.approx((np.diff(np.r_[0, recall]) * tp / n).sum())
        curve = scoring.roc_curve(df).where(F.col("condition") == f"c{k}").orderBy(F.desc("score")).collect()
        assert [r.tpr for r in curve] == pytest.approx(recall.tolist())
    few, all_ = scoring.roc_curve(df, drop_collinear=True).count(), scoring.roc_curve(df).count()
    assert 0 < few < all_ and scoring.score(df, "roc", percondition=False).select("condition").distinct().count() == 1
    assert scoring.pr_curve(df).count() == all_


def test_other_scores(spark):
    rng = random.Random(2)
    rows = [("a", rng.random(), rng.random()) for _ in range(50)]
    df = spark.createDataFrame(rows, "condition string, y double, p double")
    y, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = {"cor": np.corrcoef(y, p)[0, 1], "var_explained": 1 - np.var(y - p) / np.var(y), "mse": np.mean((y - p) ** 2), "MAE": np.mean(abs(y - p))}
    for name, value in want.items():
        assert scoring.score(df, name).first().value == pytest.approx(value)
    assert scoring.score(df, lambda a, b: (a * b).sum()).first().value == pytest.approx((y * p).sum())
    with pytest.raises(ValueError):
        scoring.score(df, "nothing")
    gaps = df.union(spark.createDataFrame([("a", float("nan"), 1.0)], df.schema))
    assert scoring.masked_loss(gaps).first().value == pytest.approx(want["mse"])
    scoring.check_dimensions({"x": df}, {"x": df})
    with pytest.raises(ValueError):
        scoring.check_dimensions({"x": df}, {"z": df})


def test_score_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "l", "c", 0.5)], "model string, layer string, condition string, value double")
    sinks.write_json(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    assert json.loads(text) == {"key": "m-l-c", "value": 0.5}
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert "m\tl\tc\t0.5" in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    made = []
    get = lambda: sinks.cached(spark, str(tmp_path), sinks.cache_key({"a": 1}), lambda: made.append(1) or df)
    assert get().count() == get().count() == 1 and len(made) == 1
