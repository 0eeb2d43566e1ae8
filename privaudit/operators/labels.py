"""Class labels: codes by a total join, and inference by nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privaudit.operators import neighbours


def encode(df: DataFrame, classes: DataFrame, column: str = "label") -> DataFrame:
    """Adds ``label_idx``; a label that is not in ``classes`` (``label, label_idx``) is an error."""
    known = classes.select(F.col("label").alias("_label"), "label_idx")
    joined = df.join(known, df[column] == known["_label"], "left").drop("_label")
    problem = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return joined.withColumn("label_idx", F.when(F.col("label_idx").isNull(), problem).otherwise(F.col("label_idx")).cast("int"))


def class_list(labels: list[str], spark) -> DataFrame:
    """``label, label_idx`` in the order given."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(labels)], "label string, label_idx int")


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row i of both sides (``ordinal``); unequal lengths are an error."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    joined = a.join(b, "ordinal", "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return joined.where(F.assert_true(both, F.lit("the sides have different lengths")).isNull()).drop("_l", "_r")


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Dense positions from 0 in the given order, by a two-phase count: no single task sorts all rows."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(F.col(order[0]).cast("double"), [i / n for i in range(1, n)], 10000).alias("c")).first()["c"] if n > 1 else []
    edges = sorted({float(c) for c in cuts or []})
    part = F.size(F.filter(F.array(*(F.lit(c) for c in edges)).cast("array<double>"), lambda c: c < F.col(order[0]).cast("double"))) if edges else F.lit(0)
    parted = df.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = parted.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parted.join(F.broadcast(starts), "_part").withColumn("ordinal", F.col("_start") + inner).drop("_part", "_start")


def nearest(queries: DataFrame, reference: DataFrame, k: int = 5, block_rows: int = 8192, query_rows: int = 8192, compared: dict | None = None) -> DataFrame:
    """``sample_id, ref_id, distance, rank``: the k nearest reference rows, ties to the smaller id.

    Exact: pivots and triangle inequalities rule out blocks of reference rows that hold
    none of a query's nearest.  ``queries``: ``sample_id, features``; ``reference``:
    ``ref_id, features``.
    """
    return neighbours.PivotIndex(reference, block_rows).search(queries, k, query_rows, compared)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """``sample_id, y_label``: the commonest label of the neighbours, ties to the smaller."""
    counted = neighbours.join(labels, "ref_id").groupBy("sample_id", "y_label").count()
    return counted.groupBy("sample_id").agg(F.min_by("y_label", F.struct(-F.col("count"), F.col("y_label"))).alias("y_label"))


def infer(queries: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """Labels for ``sample_id, features`` from ``ref_id, features, y_label``."""
    return vote(nearest(queries, reference.select("ref_id", "features"), k), reference.select("ref_id", "y_label"))


def knn_labels(reference: DataFrame, k: int = 5):
    """A transformer: ``samples.transform(knn_labels(reference))`` adds ``y_label``."""
    return lambda df: df.join(infer(df.select("sample_id", "features"), reference, k), "sample_id")


def constant(df: DataFrame) -> DataFrame:
    """The label of an unconditional family: 0 for every row."""
    return df.withColumn("y_label", F.lit(0))
