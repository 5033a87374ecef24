"""Scores of predictions per condition, as aggregations.

Rank statistics first aggregate to distinct scores; their running sums go over value ranges of about equal
weight and a short list of range totals, so that no task sorts all predictions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

RANGES = 512


def thresholds(df: DataFrame, by: list[str] = ("condition",), label: str = "y", score: str = "p", ranges: int = RANGES) -> DataFrame:
    """(by, score, pos, neg, tp, fp): for each distinct score from the top, its labels and those at or above it."""
    return _ranged(df, list(by), label, score, ranges).drop("_range")


def _ranged(df: DataFrame, by: list[str], label: str, score: str, ranges: int) -> DataFrame:
    held = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("neg"))
    cuts = held.groupBy(*by).agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"))
    placed = held.join(F.broadcast(cuts), by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("score")))).drop("_cuts")
    totals = placed.groupBy(*by, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "_range", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_bn"))
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({"_ip": F.sum("pos").over(inside), "_in": F.sum("neg").over(inside)}).join(base, [*by, "_range"])
    return out.select(*by, "_range", "score", "pos", "neg", (F.col("_bp") + F.col("_ip")).alias("tp"), (F.col("_bn") + F.col("_in")).alias("fp"))


def roc_auc(df: DataFrame, by: list[str] = ("condition",), label: str = "y", score: str = "p") -> DataFrame:
    """Area under the ROC curve; ties count half."""
    t = thresholds(df, by, label, score)
    below = F.sum(F.col("pos") * (F.col("_n") - F.col("fp") + F.col("neg") / 2))
    sums = t.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return t.join(F.broadcast(sums), list(by)).groupBy(*by, "_p", "_n").agg(below.alias("_u")).select(*by, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("value"))


def average_precision(df: DataFrame, by: list[str] = ("condition",), label: str = "y", score: str = "p") -> DataFrame:
    """The mean over positives of the precision at their threshold."""
    t = thresholds(df, by, label, score)
    out = t.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_s"), F.sum("pos").alias("_p"))
    return out.select(*by, F.try_divide(F.col("_s"), F.col("_p")).alias("value"))


def roc_curve(df: DataFrame, by: list[str] = ("condition",), label: str = "y", score: str = "p", drop_collinear: bool = False) -> DataFrame:
    """(score, fpr, tpr) at all thresholds, or without the points inside straight runs."""
    t = _ranged(df, list(by), label, score, RANGES)
    sums = t.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    t = t.join(F.broadcast(sums), list(by))
    if drop_collinear:
        # the next threshold is in the same range, or the first of the next one: a list with a row a range
        by_range = [*by, "_range"]
        w, ranges = Window.partitionBy(*by_range).orderBy(F.desc("score")), Window.partitionBy(*by).orderBy(F.desc("_range"))
        point = F.struct("pos", "neg")
        firsts = t.groupBy(*by_range).agg(F.max_by(point, "score").alias("_first")).withColumn("_after", F.lead("_first").over(ranges)).drop("_first")
        t = t.withColumn("_next", F.lead(point).over(w)).join(firsts, by_range).withColumn("_next", F.coalesce("_next", "_after"))
        t = t.where(F.col("_next").isNull() | (F.col("pos") * F.col("_next.neg") != F.col("neg") * F.col("_next.pos")))
    return t.select(*by, "score", F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"))


def pr_curve(df: DataFrame, by: list[str] = ("condition",), label: str = "y", score: str = "p") -> DataFrame:
    """(score, precision, recall) at all thresholds."""
    t = thresholds(df, by, label, score)
    sums = t.groupBy(*by).agg(F.sum("pos").alias("_p"))
    return t.join(F.broadcast(sums), list(by)).select(*by, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "_p").alias("recall"))


def _simple(name: str):
    y, p = F.col("y"), F.col("p")
    return {"cor": F.corr("y", "p"), "var_explained": 1 - F.var_pop(y - p) / F.var_pop(y), "mse": F.avg((y - p) * (y - p)), "mae": F.avg(F.abs(y - p))}[name]


NAMES = {
    **dict.fromkeys(("auc", "AUC", "auROC", "auroc"), roc_auc),
    **dict.fromkeys(("auprc", "auPRC", "ap", "AP"), average_precision),
    **dict.fromkeys(("ROC", "roc"), roc_curve),
    **dict.fromkeys(("PRC", "prc"), pr_curve),
    **{n: (lambda df, by=("condition",), k=k: df.groupBy(*by).agg(_simple(k).alias("value"))) for n, k in {"cor": "cor", "pearson": "cor", "var_explained": "var_explained", "mse": "mse", "MSE": "mse", "mae": "mae", "MAE": "mae"}.items()},
}


def score(df: DataFrame, how: str | Callable, percondition: bool = True) -> DataFrame:
    """Scores of (condition, y, p) rows by a metric's name, or by a function of two arrays per condition."""
    if not percondition:
        df = df.withColumn("condition", F.lit("across"))
    if callable(how):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"condition": [pdf["condition"].iloc[0]], "value": [float(how(pdf["y"].to_numpy(), pdf["p"].to_numpy()))]})

        ship(df.sparkSession)
        return df.select("condition", "y", "p").groupBy("condition").applyInPandas(run, "condition string, value double")
    if how not in NAMES:
        raise ValueError(f"unknown score {how}")
    return NAMES[how](df)


class Scorer:
    """A score of each layer and condition, and what writes it.

    ``score_fct``: a metric's name, a function of (labels, predictions), or, without outputs, of predictions; None keeps the
    predictions. Its exporter is called as (folder, name, results, key columns) after each scoring, or by ``export`` for all
    scorings together. ``conditions`` name conditions that are numbers.
    """

    def __init__(self, name: str, score_fct: str | Callable | None = None, conditions: list[str] | None = None, exporter: Callable | None = None, immediate_export: bool = True, percondition: bool = True, subdir: str = "evaluation"):
        if isinstance(score_fct, str) and score_fct not in NAMES:
            raise ValueError(f"unknown score {score_fct}")
        self.name, self.how, self.conditions, self.percondition = name, score_fct, conditions, percondition
        self.exporter, self.immediate, self.subdir = exporter, immediate_export, subdir
        self.results: DataFrame | None = None

    def _named(self, df: DataFrame) -> DataFrame:
        if self.conditions is None or dict(df.dtypes)["condition"] == "string":
            return df
        return df.withColumn("condition", F.get(F.array(*map(F.lit, self.conditions)), F.col("condition").cast("int")))

    def _layer(self, predicted: DataFrame, outputs: DataFrame | None) -> DataFrame:
        if outputs is not None:
            at = [c for c in predicted.columns if c != "value"]
            rows = self._named(outputs.withColumnRenamed("value", "y").join(predicted.withColumnRenamed("value", "p"), at))
            return score(rows, self.how, self.percondition)
        rows = self._named(predicted)
        if self.how is None:
            return rows if self.percondition else rows.withColumn("condition", F.lit("across"))
        if isinstance(self.how, str):
            raise ValueError(f"{self.how} needs outputs")
        how = self.how
        return score(rows.select("condition", F.col("value").alias("y"), F.col("value").alias("p")), lambda _, p: how(p), self.percondition)

    def score(self, predicted: dict[str, DataFrame], outputs: dict[str, DataFrame] | None = None, model: str = "model", folder: str | None = None, datatags: list[str] | None = None) -> DataFrame:
        """(model, layer, condition, value) rows of layers' (condition, value) rows, paired by all their other columns."""
        if outputs is not None:
            if self.how is None:
                raise ValueError("outputs need a score")
            check_dimensions(outputs, predicted)
        out = None
        for layer, rows in predicted.items():
            one = self._layer(rows, outputs and outputs[layer])
            one = one.select(F.lit(model).alias("model"), F.lit(layer).alias("layer"), *one.columns)
            out = one if out is None else out.unionByName(one)
        if self.immediate:
            if folder is not None:
                self._write(out, folder, model, datatags, ["layer", "condition"] if len(predicted) > 1 else ["condition"])
        else:
            self.results = out if self.results is None else self.results.unionByName(out)
        return out

    def export(self, folder: str, collection: str, datatags: list[str] | None = None) -> None:
        """Writes what was scored so far; nothing where nothing was."""
        if self.results is not None:
            self._write(self.results, folder, collection, datatags, ["model", "layer", "condition"])

    def _write(self, results: DataFrame, folder: str, collection: str, datatags: list[str] | None, keys: list[str]) -> None:
        from ..sources.sinks import ExportJson

        at = [folder, self.subdir, collection, *(["-".join(datatags)] if datatags else [])]
        (self.exporter or ExportJson())("/".join(at), self.name, results, keys)


def masked_loss(df: DataFrame, loss: str = "mse") -> DataFrame:
    """(condition, value): a mean loss over the rows whose target isn't missing."""
    y, p = F.col("y"), F.col("p")
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    known = {"mse": (y - p) * (y - p), "mae": F.abs(y - p), "binary_crossentropy": -(y * F.log(q) + (1 - y) * F.log(1 - q))}
    return df.groupBy("condition").agg(F.avg(F.when(y.isNotNull() & ~F.isnan(y), known[loss])).alias("value"))


def check_dimensions(outputs: dict[str, DataFrame], predictions: dict[str, DataFrame]) -> None:
    """Raises unless layers agree in names and columns."""
    if set(outputs) != set(predictions):
        raise ValueError(f"layers differ: {sorted(outputs)} and {sorted(predictions)}")
    for name, df in outputs.items():
        if df.columns != predictions[name].columns:
            raise ValueError(f"{name}: columns differ")
