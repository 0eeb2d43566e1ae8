"""Sufficient statistics of wide rows: n, sums and products per group, then mean and spectrum.

A row may belong to many splits (an array), so the samples are read once for all
splits, not once for each.  Rows are centred at their label's overall mean before
products are taken, and groups at their own afterwards, so columns whose mean dwarfs
their deviation lose nothing.  Tasks add up n, the sum and the product matrix of their
rows per group (rows of one membership pattern are multiplied once) and emit the matrix
row by row.  The rows meet by (group, block of matrix rows), so a task adds up some
vectors; only the finished d x d matrix of a group is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.operators.scaler import transform_matrix

PARAMS = "split_no int, label_idx int, n long, mean array<double>, eigvals array<double>, eigvecs array<double>"
#: Matrix rows of a group that one task adds up.
_BLOCK_ROWS = 64


def diagonal(cells: DataFrame, keys: list[str], floor: float = 1e-6) -> DataFrame:
    """``keys, n, mean, var`` per column of long cells (``value``); population variance, floored."""
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.greatest(F.var_pop("value"), F.lit(floor)).alias("var"))


def wide_matrix(lists: pa.Array) -> np.ndarray:
    """An array of equally long lists as rows by columns."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(lists), -1) if len(lists) else values.reshape(0, 0)


def wide_lists(X: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1) * X.shape[1], pa.int32()), pa.array(X.ravel(), kind))


def _label_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        X, labels = wide_matrix(batch.column(1)), batch.column(0).to_numpy()
        for label in np.unique(labels).tolist():
            part = X[labels == label]
            own = sums.setdefault(label, [0, np.zeros(X.shape[1])])
            own[0] += len(part)
            own[1] += part.sum(axis=0)
    for label, (n, s) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["label_idx", "n", "v"])


def _label_mean(table: pa.Table) -> pa.Table:
    mean = wide_matrix(table["v"].combine_chunks()).sum(axis=0) / np.sum(table["n"].to_numpy())
    return pa.table({"label_idx": table["label_idx"][:1], "mean": pa.array([mean.tolist()], pa.list_(pa.float64()))})


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The overall mean of each label: a vector a label, whatever the rows."""
    wide = rows.select(F.col("label_idx").cast("int"), F.col("features").cast("array<double>"))
    found = wide.mapInArrow(_label_sums, "label_idx int, n long, v array<double>").groupBy("label_idx").applyInArrow(_label_mean, "label_idx int, mean array<double>")
    return {r["label_idx"]: np.array(r["mean"]) for r in found.collect()}


def _products(centre: dict[int, np.ndarray], quantiles: dict[int, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}

        def add(group: tuple[int, int], n: int, s: np.ndarray, m: np.ndarray) -> None:
            own = sums.setdefault(group, [0, np.zeros_like(s), np.zeros_like(m)])
            own[0] += n
            own[1] += s
            own[2] += m

        for batch in batches:
            lists, labels, X = batch.column(0), batch.column(1).to_numpy(), wide_matrix(batch.column(2))
            numbers, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            inside = np.zeros((len(X), len(numbers)), bool)
            inside[np.repeat(np.arange(len(X)), lists.value_lengths().to_numpy()), column] = True
            if quantiles is None and len(X):
                X = X - np.stack([centre[k] for k in labels.tolist()])
                patterns, of = np.unique(np.column_stack([labels, inside]), axis=0, return_inverse=True)
                if 8 * len(patterns) <= len(X):
                    for k, (label, *pattern) in enumerate(patterns.tolist()):
                        part = X[of.ravel() == k]
                        s, m = part.sum(axis=0), part.T @ part
                        for number in numbers[np.array(pattern, bool)].tolist():
                            add((number, label), len(part), s, m)
                    continue
            for j, number in enumerate(numbers.tolist()):
                Z, own = X[inside[:, j]], labels[inside[:, j]]
                if quantiles is not None:
                    Z = transform_matrix(Z, quantiles[number])
                for label in np.unique(own).tolist():
                    part = Z[own == label]
                    add((number, label), len(part), part.sum(axis=0), part.T @ part)
        for (number, label), (n, s, m) in sums.items():
            rows = len(m) + 1
            columns = [pa.array([x] * rows, k) for x, k in ((number, pa.int32()), (label, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(-1, len(m)), pa.int32()), pa.array([n] * rows, pa.int64()), wide_lists(np.vstack([s, m]))], names=["split_no", "label_idx", "row", "n", "v"])

    return run


def _added(table: pa.Table) -> pa.Table:
    rows, at = np.unique(table["row"].to_numpy(), return_inverse=True)
    n, v = np.zeros(len(rows), np.int64), wide_matrix(table["v"].combine_chunks())
    total = np.zeros((len(rows), v.shape[1]))
    np.add.at(n, at, table["n"].to_numpy())
    np.add.at(total, at, v)
    keys = {c: pa.array([table[c][0].as_py()] * len(rows), pa.int32()) for c in ("split_no", "label_idx")}
    return pa.table({**keys, "row": pa.array(rows, pa.int32()), "n": pa.array(n), "v": wide_lists(total)})


def sufficient(rows: DataFrame, centre: dict[int, np.ndarray], quantiles: dict[int, np.ndarray] | None = None) -> DataFrame:
    """``split_no, label_idx, row, n, v`` of ``split_no`` or ``splits`` (an array), ``label_idx, features``; row -1 holds the sums.

    Sums and products are those of rows less their label's ``centre``, or of rows scaled with their split's ``quantiles``.
    """
    splits = F.col("splits") if "splits" in rows.columns else F.array("split_no")
    wide = rows.select(splits.cast("array<int>").alias("splits"), F.col("label_idx").cast("int"), F.col("features").cast("array<double>"))
    kinds = "split_no int, label_idx int, row int, n long, v array<double>"
    parts = wide.mapInArrow(_products(centre, quantiles), kinds).withColumn("block", F.floor((F.col("row") + 1) / _BLOCK_ROWS))
    return parts.groupBy("split_no", "label_idx", "block").applyInArrow(_added, kinds)


def _spectrum(centre: dict[int, np.ndarray], floor: float):
    def run(table: pa.Table) -> pa.Table:
        labels = np.array(table["label_idx"].to_pylist())
        n_all, scatter, means, sizes = 0, None, {}, {}
        for label in sorted(set(labels.tolist())):
            part = table.filter(pa.array(labels == label))
            order = np.argsort(part["row"].to_numpy())
            V, n = wide_matrix(part["v"].combine_chunks())[order], part["n"][0].as_py()
            shift = V[0] / n
            means[label], sizes[label] = centre[label] + shift if centre else shift, n
            within = V[1:] - n * np.outer(shift, shift)
            scatter, n_all = within if scatter is None else scatter + within, n_all + n
        values, vectors = np.linalg.eigh(scatter / n_all)
        values, vectors = np.maximum(values[::-1], floor), vectors[:, ::-1]
        k = len(means)
        split = table["split_no"][0].as_py()
        same = lambda v: wide_lists(np.tile(v.ravel(), (k, 1)))
        return pa.table({"split_no": pa.array([split] * k, pa.int32()), "label_idx": pa.array(list(means), pa.int32()), "n": pa.array([sizes[v] for v in means], pa.int64()), "mean": wide_lists(np.array([*means.values()])), "eigvals": same(values), "eigvecs": same(vectors)})

    return run


def spectrum(rows: DataFrame, floor: float = 1e-6, quantiles: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Per split: class means and the spectrum of the pooled within-class covariance, largest first; of scaled rows if there are ``quantiles``."""
    centre = {} if quantiles is not None else centres(rows)
    return sufficient(rows, centre, quantiles).groupBy("split_no").applyInArrow(_spectrum(centre, floor), PARAMS)


# ---- the top of the spectrum, for rows too wide for a d x d matrix


def _by_split(lists: pa.Array, chosen: dict) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each chosen split."""
    row, number = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    for s in chosen:
        own = row[number == s]
        if len(own):
            yield s, own


def _scan(rows: DataFrame, chosen: dict, centre: dict[int, np.ndarray], quantiles: dict[int, np.ndarray] | None, task) -> dict[tuple[int, int], np.ndarray]:
    """Adds up what ``task(split, label, rows)`` gives, a matrix for each split and label, in one scan of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            labels, X = batch.column(1).to_numpy(), wide_matrix(batch.column(2))
            for s, own in _by_split(batch.column(0), chosen):
                for label in np.unique(labels[own]).tolist():
                    part = X[own[labels[own] == label]]
                    part = part - centre[label] if quantiles is None else transform_matrix(part, quantiles[s])
                    for key, m in task(s, label, part):
                        sums[key] = sums[key] + m if key in sums else m
        for (s, k), m in sums.items():
            ids = [pa.array(np.full(len(m), x), pa.int32()) for x in (s, k)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.arange(len(m)), pa.int32()), pa.array(np.zeros(len(m)), pa.int64()), wide_lists(m)], names=["split_no", "label_idx", "row", "n", "v"])

    splits = F.col("splits") if "splits" in rows.columns else F.array("split_no")
    wide = rows.select(splits.cast("array<int>").alias("splits"), F.col("label_idx").cast("int"), F.col("features").cast("array<double>"))
    kinds = "split_no int, label_idx int, row int, n long, v array<double>"
    parts = wide.mapInArrow(run, kinds).withColumn("block", F.floor(F.col("row") / _BLOCK_ROWS))
    found = parts.groupBy("split_no", "label_idx", "block").applyInArrow(_added, kinds).orderBy("split_no", "label_idx", "row")
    out: dict[tuple[int, int], list] = {}
    for r in found.toLocalIterator():
        out.setdefault((r["split_no"], r["label_idx"]), []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def top_spectrum(rows: DataFrame, rank: int, numbers: list[int], floor: float = 1e-6, quantiles: dict[int, np.ndarray] | None = None, extra: int = 16, rounds: int = 3, held: int = 64 << 20) -> DataFrame:
    """Class means and the ``rank`` largest eigenvalues with their vectors, and the mean of all the others, as of ``spectrum``.

    A randomised range finder: each scan multiplies every split's covariance with a thin
    matrix (d x (rank + extra)), whose orthonormal basis is the next one; after ``rounds``
    of them the covariance within the basis gives the values.  No task and no driver holds
    a d x d matrix; splits are taken as many at a time as have ``held`` bytes of thin
    matrices.  ``eigvals`` has rank + 1 values, ``eigvecs`` d x rank.
    """
    centre, out = {} if quantiles is not None else centres(rows), []
    first = rows.select(F.size("features").alias("d")).first()
    d = first["d"] if first else 0
    rank = max(1, min(rank, d - 1))
    width = min(d, rank + extra)
    start = np.random.default_rng(0).normal(size=(d, width))
    step = max(1, held // (8 * max(1, d * width)))
    for at in range(0, len(numbers), step):
        some = numbers[at : at + step]
        sums = _scan(rows, dict.fromkeys(some), centre, quantiles, lambda s, label, X: [((s, label), np.vstack([X.sum(axis=0), [len(X), (X**2).sum(), *[0.0] * (d - 2)]]))])
        groups = {s: {k: (v[1, 0], v[0] / v[1, 0], v[1, 1]) for (t, k), v in sums.items() if t == s} for s in some}
        groups = {s: g for s, g in groups.items() if g}
        V = dict.fromkeys(groups, start)
        for turn in range(rounds + 1):
            Y = _scan(rows, V, centre, quantiles, lambda s, label, X: [((s, 0), X.T @ (X @ V[s]))])  # noqa: B023
            n = {s: sum(g[0] for g in groups[s].values()) for s in groups}
            Y = {s: (Y[s, 0] - sum(m * np.outer(shift, shift @ V[s]) for m, shift, _ in groups[s].values())) / n[s] for s in groups}
            if turn < rounds:
                V = {s: np.linalg.qr(y)[0] for s, y in Y.items()}
        for s in groups:
            small = V[s].T @ Y[s]
            values, inner = np.linalg.eigh((small + small.T) / 2)
            values, vectors = values[::-1][:rank], V[s] @ inner[:, ::-1][:, :rank]
            trace = sum(square - m * (shift @ shift) for m, shift, square in groups[s].values()) / n[s]
            values = np.maximum([*values, (trace - values.sum()) / (d - rank)], floor)
            for label, (m, shift, _) in sorted(groups[s].items()):
                out.append((s, label, int(m), (centre[label] + shift if centre else shift).tolist(), values.tolist(), vectors.ravel().tolist()))
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3]
    names = ["split_no", "label_idx", "n", "mean", "eigvals", "eigvecs"]
    table = pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=names)
    return rows.sparkSession.createDataFrame(table)
