"""Exact nearest neighbours by pivots.

Reference rows belong to the nearest of some pivots and stand in blocks of bounded size,
rings of like distance to their pivot.  No row of a block is nearer to a query than

* the query's distance to the pivot less the ring's outer edge, or the inner edge less it;
* half of what the query is farther from the block's pivot than from its own nearest one.

Each query first meets the blocks of smallest bound that hold k rows; the k-th distance
found there rules out all blocks with a larger bound, and it meets the others.  So
what is compared follows the data's structure, and the result is that of all pairs.

Pivots come from about ``_SAMPLE`` rows (a documented bound); with the blocks' edges they
are all that goes to the tasks.  A block that many queries ask for is compared by several
tasks, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privaudit.operators.statistics import wide_matrix
from privaudit.sources.stages import written

#: Rows the pivots are drawn from, pivots at most, and rounds that improve them.
_SAMPLE, _MOST_PIVOTS, _ROUNDS = 20_000, 2048, 5
#: What bounds are loosened by, relative to the distances they come from.
_SLACK = 1e-9


def squared(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Squared distances by matrix products, exact but for rounding."""
    return np.maximum((X**2).sum(axis=1)[:, None] + (Y**2).sum(axis=1)[None, :] - 2 * X @ Y.T, 0.0)


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots spread over the sample, moved to the middle of what is nearest to them."""
    rng = np.random.default_rng(3)
    chosen = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(_ROUNDS):
        near = np.concatenate([squared(sample[at : at + 4096], chosen).argmin(axis=1) for at in range(0, len(sample), 4096)])
        sums, sizes = np.zeros_like(chosen), np.bincount(near, minlength=len(chosen))
        np.add.at(sums, near, sample)
        chosen = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], chosen)
    return chosen


def exact(X: np.ndarray, Y: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of X the rows of Y among which its k nearest are, nearest first (ties by place), and their distances."""
    y = (Y**2).sum(axis=1)
    for at in range(0, len(X), 256):
        part = X[at : at + 256]
        about = squared(part, Y)
        edge = np.partition(about, min(k, len(Y)) - 1, axis=1)[:, min(k, len(Y)) - 1]
        slack = _SLACK * ((part**2).sum(axis=1) + y.max())
        for i, row in enumerate(about):
            near = np.flatnonzero(row <= edge[i] + slack[i])
            d = ((Y[near] - part[i]) ** 2).sum(axis=1)
            best = np.argsort(d, kind="stable")[:k]
            yield at + i, near[best], np.sqrt(d[best])


class Bounds:
    """The pivots, and of each block its pivot, its ring's edges and its number of rows."""

    def __init__(self, pivots: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray):
        self.pivots, self.part, self.low, self.high, self.n = pivots, part, low, high, n

    def bounds(self, X: np.ndarray) -> np.ndarray:
        """Queries by blocks: what no row of a block is nearer than."""
        away = np.sqrt(squared(X, self.pivots))
        slack = _SLACK * (1 + away.max() + np.abs(X).max() + np.abs(self.pivots).max()) + np.sqrt(_SLACK * 1e-3) * np.abs(X).max()
        own, to = away.min(axis=1)[:, None], away[:, self.part]
        return np.maximum(np.maximum(to - self.high, self.low - to), (to - own) / 2) - slack

    def first(self, k: int):
        """The blocks of smallest bound that hold k rows."""

        def choose(X: np.ndarray, _) -> list[np.ndarray]:
            out = []
            for row in self.bounds(X):
                order = np.argsort(row, kind="stable")
                out.append(order[: int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1])
            return out

        return choose

    def others(self, k: int):
        """The blocks not met that may hold a row as near as the k-th found."""

        def choose(X: np.ndarray, worst: np.ndarray) -> list[np.ndarray]:
            first = self.first(k)(X, None)
            return [np.setdiff1d(np.flatnonzero(row <= w), met) for row, w, met in zip(self.bounds(X), worst, first)]

        return choose


class PivotIndex:
    """Blocks of the rows of ``reference`` (``ref_id, features``), about ``block_rows`` in each."""

    def __init__(self, reference: DataFrame, block_rows: int = 8192):
        wide = reference.select("ref_id", F.col("features").cast("array<double>").alias("features"))
        self.rows_in, n = block_rows, reference.count()
        share = F.pmod(F.xxhash64("ref_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = wide.where(share < F.lit(min(1.0, _SAMPLE / max(1, n)))).select("features").collect()  # about _SAMPLE rows
        self.pivots = pivots_of(np.array([r["features"] for r in sample], float), min(_MOST_PIVOTS, max(1, -(-4 * n // block_rows)))) if sample else np.zeros((0, 0))
        placed = written(wide.mapInArrow(self._placed(), f"ref_id {dict(reference.dtypes)['ref_id']}, features array<double>, part int, away double"), "pivot-rows")
        # rings of about block_rows rows; what ties leave in one is dealt by hash
        sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("rings"), F.percentile_approx("away", [i / 64 for i in range(1, 64)], 1000).alias("edges"))
        ring = F.size(F.filter("edges", lambda e: e < F.col("away")))
        rings = placed.join(sizes, "part").withColumn("ring", F.floor(ring * F.least("rings", F.lit(64)) / 64).cast("int"))
        counts = rings.groupBy("part", "ring").count().select("part", "ring", F.ceil(F.col("count") / F.lit(2 * block_rows)).cast("int").alias("deals"))
        dealt = rings.drop("rings", "edges").join(counts, ["part", "ring"]).withColumn("deal", F.pmod(F.xxhash64("ref_id"), "deals").cast("int"))
        stats = dealt.groupBy("part", "ring", "deal").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n")).orderBy("part", "ring", "deal").collect()  # a row a block
        keys = reference.sparkSession.createDataFrame([(r["part"], r["ring"], r["deal"], i) for i, r in enumerate(stats)], "part int, ring int, deal int, block int")
        #: ``ref_id, features, block``.
        self.blocks = written(dealt.join(keys, ["part", "ring", "deal"]).select("ref_id", "features", "block"), "pivot-blocks")
        self.bounds = Bounds(self.pivots, *(np.array([r[c] for r in stats]) for c in ("part", "low", "high", "n")))

    def _placed(self):
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                X = wide_matrix(batch.column(1))
                part = squared(X, pivots).argmin(axis=1) if len(X) else np.zeros(0, int)
                away = np.sqrt(((X - pivots[part]) ** 2).sum(axis=1)) if len(X) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array(away)], names=["ref_id", "features", "part", "away"])

        return run

    def visits(self, queries: DataFrame, choose) -> DataFrame:
        """``sample_id, block`` of ``queries`` (``sample_id, features, worst``)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    blocks = choose(wide_matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False))
                    rows = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(blocks), pa.int32())], names=["sample_id", "block"])

        return queries.select("sample_id", "features", "worst").mapInArrow(run, f"sample_id {dict(queries.dtypes)['sample_id']}, block int")

    def compare(self, queries: DataFrame, visits: DataFrame, k: int, query_rows: int) -> DataFrame:
        """``sample_id, ref_id, distance``: of each block the k nearest to each query that meets it."""
        asked = visits.groupBy("block").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("calls"))
        left = visits.join(asked, "block").join(queries.select("sample_id", "features"), "sample_id").withColumn("call", F.pmod(F.xxhash64("sample_id"), "calls").cast("int"))
        right = self.blocks.join(asked, "block").withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1)))
        kinds = dict(queries.dtypes)["sample_id"], dict(self.blocks.dtypes)["ref_id"]

        def run(x: pa.Table, y: pa.Table) -> pa.Table:
            schema = pa.schema([("sample_id", x.schema.field("sample_id").type), ("ref_id", y.schema.field("ref_id").type), ("distance", pa.float64())])
            if not x.num_rows or not y.num_rows:
                return schema.empty_table()
            order = np.argsort(np.array(y["ref_id"].to_pylist()), kind="stable")
            X, Y, ids = wide_matrix(x["features"].combine_chunks()), wide_matrix(y["features"].combine_chunks())[order], y["ref_id"].take(pa.array(order))
            found = [(np.full(len(near), i), near, d) for i, near, d in exact(X, Y, k)]
            rows, near, d = (np.concatenate(c) for c in zip(*found))
            return pa.Table.from_arrays([x["sample_id"].take(pa.array(rows)).combine_chunks(), ids.take(pa.array(near)).combine_chunks(), pa.array(d)], schema=schema)

        groups = left.select("block", "call", "sample_id", "features").groupBy("block", "call").cogroup(right.select("block", "call", "ref_id", "features").groupBy("block", "call"))
        return groups.applyInArrow(run, f"sample_id {kinds[0]}, ref_id {kinds[1]}, distance double")

    def search(self, queries: DataFrame, k: int, query_rows: int = 8192, compared: dict | None = None) -> DataFrame:
        """``sample_id, ref_id, distance, rank`` of ``queries`` (``sample_id, features``); ``compared`` receives the pairs of a query and a block, and those that are."""
        asked = queries.select("sample_id", F.col("features").cast("array<double>").alias("features"), F.lit(None).cast("double").alias("worst"))
        if not len(self.bounds.n):
            return asked.select("sample_id").limit(0).withColumns({"ref_id": F.lit(None).cast(dict(self.blocks.dtypes)["ref_id"]), "distance": F.lit(0.0), "rank": F.lit(1)})
        first = written(self.visits(asked, self.bounds.first(k)), "pivot-first")
        found = written(self.compare(asked, first, k, query_rows), "pivot-found")
        place = F.row_number().over(Window.partitionBy("sample_id").orderBy("distance"))
        kth = found.withColumn("place", place).where(F.col("place") == k).select("sample_id", F.col("distance").alias("worst"))
        again = asked.drop("worst").join(kth, "sample_id", "left").fillna(float("inf"), ["worst"])
        others = written(self.visits(again, self.bounds.others(k)), "pivot-others")
        if compared is not None:
            compared["met"], compared["all"] = first.count() + others.count(), queries.count() * len(self.bounds.n)
        found = found.union(self.compare(asked, others, k, query_rows))
        rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("distance", "ref_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
