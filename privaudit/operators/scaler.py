"""Quantile normalisation of matrix columns to a normal distribution.

Fit: quantiles at min(1000, n) even levels by linear interpolation, made monotone.
Exact at any size: values are counted, running counts come from value ranges and
their totals, and a level takes the two values that stand at its place.
Transform: interpolate forward and backward and average (ties), inverse normal,
clip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privaudit.functions.normal import cdf_array, ppf, ppf_array
from privaudit.operators.metrics import ranged, running

MOST = 1000
_EDGE = 1e-7


def fit(cells: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """``keys, quantiles`` from long cells (``keys, value``); ``n``: rows per column, which sets the number of levels (each column's own if none)."""
    last = (F.greatest(F.lit(2), F.least(F.lit(MOST), F.col("rows"))) - 1).cast("int") if n is None else F.lit(max(2, min(MOST, n)) - 1)
    counts = cells.where("value is not null").groupBy(*keys, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("times"))
    placed = running(ranged(counts, "value"), keys, [F.asc("value")], F.asc("part"), {"before": "times"}, inclusive=False)
    totals = counts.groupBy(*keys).agg(F.sum("times").alias("rows"))
    # a value holds the places before .. before + times - 1; level i is at place i / last * (rows - 1)
    rows = placed.join(F.broadcast(totals), keys).withColumn("step", (F.col("rows") - 1) / last.cast("double"))
    low = F.when(F.col("step") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col("before") - 1) / F.col("step")) - 1)).cast("int")
    high = F.when(F.col("step") == 0, last).otherwise(F.least(last, F.ceil((F.col("before") + F.col("times")) / F.col("step")) + 1)).cast("int")
    place = F.col("i") / last.cast("double") * (F.col("rows") - 1)
    held = lambda at: F.when((at >= F.col("before")) & (at < F.col("before") + F.col("times")), F.col("value"))
    near = rows.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("i"))
    ends = near.select(*keys, "i", (place - F.floor(place)).alias("share"), held(F.floor(place)).alias("a"), held(F.ceil(place)).alias("b")).where("a is not null or b is not null")
    at = ends.groupBy(*keys, "i").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("share").alias("share"))
    levels_of = at.select(*keys, "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("q"))
    grown = F.max("q").over(Window.partitionBy(*keys).orderBy("i"))  # a row per level
    ordered = levels_of.select(*keys, F.struct("i", grown.alias("q")).alias("q")).groupBy(*keys).agg(F.sort_array(F.collect_list("q")).alias("q"))
    return ordered.select(*keys, F.transform("q", lambda x: x["q"]).alias("quantiles"))


def _knots(quantiles: Column, holds) -> Column:
    """How many of the first knots hold, by halving steps."""
    n, steps = F.size(quantiles), [1 << k for k in range(MOST.bit_length() - 1, -1, -1)]

    def step(at: Column, s: Column) -> Column:
        inside = at + s <= n
        return F.when(inside & holds(F.get(quantiles, F.when(inside, at + s - 1).otherwise(0))), at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def uniform(value: Column, quantiles: Column) -> Column:
    """The average of forward and backward interpolation; 0 and 1 at and beyond the ends."""
    n = F.size(quantiles)
    counts = F.struct(_knots(quantiles, lambda q: q <= value).alias("below"), _knots(quantiles, lambda q: q < value).alias("under"))

    def at(i: Column) -> Column:
        return F.get(quantiles, i.cast("int"))

    def placed(c: Column) -> Column:
        left = c["below"] - 1
        a, b = at(left), at(left + 1)
        tied = ((left + c["under"]) / F.lit(2.0)) / (n - 1)
        return F.when(c["below"] > c["under"], tied).otherwise((left + (value - a) / (b - a)) / (n - 1))

    # a lambda's argument is computed once, a column at each of its uses
    inner = F.get(F.transform(F.array(counts), placed), F.lit(0))
    return F.when(value <= at(F.lit(0)), F.lit(0.0)).when(value >= at(n - 1), F.lit(1.0)).otherwise(inner)


def normal(value: Column, quantiles: Column) -> Column:
    """A cell's normal score."""
    u = uniform(value, quantiles)
    return ppf(F.least(F.greatest(u, F.lit(_EDGE - 2.0**-52)), F.lit(1.0 - (_EDGE - 2.0**-52))))


def transform_matrix(X: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """Rows by columns; ``Q``: columns by quantiles."""
    refs, out = np.linspace(0, 1, Q.shape[1]), np.empty_like(X, dtype=float)
    for j in range(X.shape[1]):
        q, x = Q[j], X[:, j]
        u = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
        u = np.where(x <= q[0], 0.0, np.where(x >= q[-1], 1.0, u))
        out[:, j] = ppf_array(np.clip(u, _EDGE - 2.0**-52, 1 - (_EDGE - 2.0**-52)))
    return out


def inverse_matrix(Z: np.ndarray, Q: np.ndarray) -> np.ndarray:
    refs, U = np.linspace(0, 1, Q.shape[1]), cdf_array(Z)
    return np.column_stack([np.interp(U[:, j], refs, Q[j]) for j in range(Z.shape[1])])


def quantile_matrix(scaler: DataFrame, order: str = "gene_idx") -> np.ndarray:
    """A split's quantiles on the driver: columns by at most 1000 numbers, whatever the rows."""
    return np.array([r["quantiles"] for r in scaler.orderBy(order).collect()], float)


def quantile_matrices(scalers: DataFrame) -> dict[int, np.ndarray]:
    """The quantiles of the splits in ``split_no, gene_idx, quantiles``, as of ``quantile_matrix``."""
    out: dict[int, list] = {}
    for r in scalers.orderBy("split_no", "gene_idx").toLocalIterator():
        out.setdefault(r["split_no"], []).append(np.array(r["quantiles"]))
    return {k: np.array(v) for k, v in out.items()}


def apply_rows(rows: DataFrame, Q: np.ndarray, inverse: bool = False) -> DataFrame:
    """Scale the ``features`` arrays of wide rows; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("features")
            X = np.array(batch.column(i).to_pylist(), float).reshape(batch.num_rows, -1)
            Z = (inverse_matrix if inverse else transform_matrix)(X, Q) if batch.num_rows else X
            yield batch.set_column(i, "features", pa.array(list(Z), pa.list_(pa.float64())))

    wide = rows.withColumn("features", F.col("features").cast("array<double>"))
    return wide.mapInArrow(run, wide.schema)
