"""Subsets and views of datasets, which share their data and differ in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _listed(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def subset(df: DataFrame, include=None, exclude=None) -> DataFrame:
    """Rows by chromosome; neither list is an error."""
    if not include and not exclude:
        raise ValueError("include or exclude must be given")
    out = df.where(F.col("chrom").isin(_listed(include))) if include else df
    return out.where(~F.col("chrom").isin(_listed(exclude))) if exclude else out


def split_train_test(data, holdout):
    """(train, test) by chromosome, of a DataFrame or dataset, or of lists, tuples and dicts of them."""
    if isinstance(data, dict):
        both = {k: split_train_test(v, holdout) for k, v in data.items()}
        return {k: v[0] for k, v in both.items()}, {k: v[1] for k, v in both.items()}
    if isinstance(data, (list, tuple)):
        both = [split_train_test(v, holdout) for v in data]
        return type(data)(b[0] for b in both), type(data)(b[1] for b in both)
    cut = subset if isinstance(data, DataFrame) else (lambda d, **how: d.subset(**how))
    return cut(data, exclude=holdout), cut(data, include=holdout)


def common_indices(per_input: list[list[DataFrame]], key: str = "idx") -> DataFrame:
    """Of each input the union of its index lists, of all inputs the intersection."""
    out = None
    for lists in per_input:
        one = None
        for df in lists:
            one = df.select(key) if one is None else one.union(df.select(key))
        one = one.distinct()
        out = one if out is None else out.intersect(one)
    return out


def matching_conditions(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose condition the pattern is found in."""
    return df.where(F.col("condition").rlike(pattern))


def compared(scores: DataFrame, contains: str = "", ascending: bool = False) -> DataFrame:
    """A score table with models by substring, in order of their scores."""
    return scores.where(F.contains(F.col("model"), F.lit(contains))).orderBy(F.col("value").asc() if ascending else F.col("value").desc(), "model")
