"""Window tensors in long form (idx, pos, strand, condition, value), and in wide form (idx, values array).

Reductions over the long form are aggregations; reshapes of the wide form permute a flat, row-major array.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

_AXES = {1: "pos", 2: "strand", 3: "condition"}


def unstack(rows: DataFrame, shape: tuple[int, int, int], values: str = "values", key: str = "idx") -> DataFrame:
    """Long form of flat arrays of (positions, strands, conditions)."""
    _, s, c = shape
    out = rows.select(key, F.posexplode(values).alias("_p", "value"))
    return out.select(key, F.floor(F.col("_p") / (s * c)).cast("int").alias("pos"), F.pmod(F.floor(F.col("_p") / c), F.lit(s)).cast("int").alias("strand"), F.pmod("_p", F.lit(c)).cast("int").alias("condition"), "value")


def reduce_dim(cells: DataFrame, aggregator: str | Callable | None = None, axis: tuple[int, ...] | None = None, key: str = "idx") -> DataFrame:
    """Reduces dense long cells over axes (1 positions, 2 strands, 3 conditions), by sum unless told otherwise."""
    axes = (1, 2) if axis is None else (axis,) if isinstance(axis, int) else tuple(axis)
    keep = [key, *(name for a, name in _AXES.items() if a not in axes)]
    if callable(aggregator):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keep}, "value": float(aggregator(pdf["value"].to_numpy()))}])

        ship(cells.sparkSession)
        schema = ", ".join(f"{c} {t}" for c, t in cells.select(keep).dtypes) + ", value double"
        return cells.groupBy(*keep).applyInPandas(run, schema)
    known = {"sum": F.sum, "mean": F.avg, "max": F.max}
    if (aggregator or "sum") not in known:
        raise ValueError(f"unknown aggregator {aggregator}")
    return cells.groupBy(*keep).agg(known[aggregator or "sum"]("value").alias("value"))


def squeeze(shape: tuple[int, ...], axis: int | tuple[int, ...] | None = None) -> tuple[int, ...]:
    """The shape without dimensions of one element; the values stay as they are."""
    axes = range(1, len(shape)) if axis is None else [axis] if isinstance(axis, int) else axis
    if axis is not None and any(shape[a] != 1 for a in axes):
        raise ValueError("only dimensions of one element can go")
    return tuple(n for i, n in enumerate(shape) if i not in axes or n != 1)


def transpose(values: Column, shape: tuple[int, ...], axes: tuple[int, ...]) -> Column:
    """A flat array of ``shape`` (without the rows) with its dimensions in the order of ``axes``."""
    if sorted(axes) != list(range(len(shape))):
        raise ValueError("axes must name each dimension once")
    stride = [prod(shape[i + 1 :]) for i in range(len(shape))]
    order = [sum(i * stride[a] for i, a in zip(at, axes)) for at in product(*(range(shape[a]) for a in axes))]
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(values, i))


def flip(values: Column, shape: tuple[int, int, int]) -> Column:
    """Positions and strands in reverse order, conditions as they are."""
    n, s, c = shape
    order = [((n - 1 - p) * s + (s - 1 - q)) * c + r for p in range(n) for q in range(s) for r in range(c)]
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(values, i))


def nan_to_num(value: Column) -> Column:
    """NaN to 0, infinities to the greatest finite numbers."""
    top = F.lit(1.7976931348623157e308)
    inf = F.lit(float("inf"))
    return F.when(F.isnan(value), 0.0).when(value == inf, top).when(value == -inf, -top).otherwise(value)


def random_scale(cells: DataFrame, deviance: float, seed: int, key: str = "idx", documented: bool = True) -> DataFrame:
    """Each (window, condition) times a random factor in 1 +- deviance; ``documented=False`` gives 1 - (u - deviance) / (2 deviance)."""
    u = F.pmod(F.xxhash64(F.lit(seed), key, "condition"), F.lit(1 << 30)) / float(1 << 30)
    factor = 1 - deviance + 2 * deviance * u if documented else 1 - (u - deviance) / (2 * deviance)
    return cells.withColumn("value", F.col("value") * factor)


def random_orientation(rows: DataFrame, shape: tuple[int, int, int], seed: int, values: str = "values", key: str = "idx") -> DataFrame:
    """Half of the windows, by a seeded hash, with positions and strands turned around."""
    heads = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)) == 0
    return rows.withColumn(values, F.when(heads, flip(F.col(values), shape)).otherwise(F.col(values)))


def random_shift(rows: DataFrame, shape: tuple[int, int, int], most: int, seed: int, values: str = "values", key: str = "idx", batchwise: bool = False, batch_size: int = 32) -> DataFrame:
    """Windows moved by a seeded shift in [-most, most) positions, zeros following."""
    by = F.floor(F.col(key) / batch_size) if batchwise else F.col(key)
    r = (F.pmod(F.xxhash64(F.lit(seed), by), F.lit(2 * most)) - most).cast("int")
    cell = shape[1] * shape[2]
    size = shape[0] * cell
    zero = lambda n: F.array_repeat(F.lit(0.0), n)
    k = F.least(F.abs(r) * cell, F.lit(size))
    right = F.concat(zero(k), F.slice(F.col(values), F.lit(1), F.lit(size) - k))
    left = F.concat(F.slice(F.col(values), k + 1, F.lit(size) - k), zero(k))
    return rows.withColumn(values, F.when(r >= 0, right).otherwise(left))


def upsample(values: Column, resolution: int) -> Column:
    return F.flatten(F.transform(values, lambda v: F.array_repeat(v, resolution)))


def zipped(inputs: dict[str, DataFrame], key: str = "idx") -> DataFrame:
    """Datasets side by side by row number; each gives one column of its name. Different lengths raise."""
    out, sizes = None, {n: d.count() for n, d in inputs.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"datasets differ in length: {sizes}")
    for name, df in inputs.items():
        one = df.select(key, F.col("values").alias(name))
        out = one if out is None else out.join(one, key)
    return out


def batches(rows: DataFrame, batch_size: int = 32, key: str = "idx", shuffle_seed: int | None = None) -> DataFrame:
    """Adds ``batch``: rows by their dense number, or by a seeded order of it."""
    if shuffle_seed is None:
        return rows.withColumn("batch", F.floor(F.col(key) / batch_size))
    from ..schema import running_total

    ranked = running_total(rows.withColumns({"_h": F.xxhash64(F.lit(shuffle_seed), key), "_one": F.lit(1)}), [], "_h", "_one", "_place", block=1 << 48)
    return ranked.withColumn("batch", F.floor(F.col("_place") / batch_size)).drop("_h", "_one", "_place")


def local_average(cells: DataFrame, width: int, key: str = "idx") -> DataFrame:
    """Moving average along positions of dense long cells, where all ``width`` neighbours exist."""
    w = Window.partitionBy(key, "strand", "condition").orderBy("pos").rowsBetween(0, width - 1)
    out = cells.withColumns({"_n": F.count("*").over(w), "_v": F.avg("value").over(w)})
    return out.where(F.col("_n") == width).withColumn("value", F.col("_v")).drop("_n", "_v")


def max_abs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Merges overlapping windows' attributions: the greatest magnitude for each position."""
    return cells.groupBy(*by).agg(F.max(F.abs("value")).alias("value"))


def predict(rows: DataFrame, model: Callable, outputs: int, values: str = "values", key: str = "idx") -> DataFrame:
    """(key, prediction array): a model over Arrow batches of flat arrays."""
    import numpy as np

    def run(parts):
        for pdf in parts:
            if len(pdf):
                y = np.asarray(model(np.stack(pdf[values].to_list()))).reshape(len(pdf), outputs)
                yield pd.DataFrame({key: pdf[key], "prediction": list(y.astype(float))})

    ship(rows.sparkSession)
    return rows.select(key, values).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, prediction array<double>")


def integrated_gradients(rows: DataFrame, gradient: Callable, columns: list[str], steps: int = 50, key: str = "idx") -> DataFrame:
    """(key, an array a column): each input times the mean of its gradients on the way from zero.

    ``gradient``: from a list of (rows, values) arrays, one a column, to a list of such arrays.
    """
    import numpy as np

    def run(parts):
        for pdf in parts:
            if len(pdf):
                x = [np.stack(pdf[c].to_list()) for c in columns]
                total = [np.zeros(v.shape) for v in x]
                for step in range(1, steps + 1):
                    for t, g in zip(total, gradient([v * (step / steps) for v in x])):
                        t += np.asarray(g).reshape(t.shape)
                yield pd.DataFrame({key: pdf[key]} | {c: list(v * t / steps) for c, v, t in zip(columns, x, total)})

    ship(rows.sparkSession)
    schema = ", ".join([f"{key} {dict(rows.dtypes)[key]}", *(f"`{c}` array<double>" for c in columns)])
    return rows.select(key, *columns).mapInPandas(run, schema)
