"""Seeded member / non-member splits.

In split i the rows are ordered by ``md5(seed + i : id)`` and the first
floor(n * ratio) are members.  The last member of each split is found by counting: rows
are counted by the first four hex digits, and only the group that the counts leave open,
a 65,536th of the rows, is sorted.  Each row is then compared with its split's last
member where it is read, so rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def order_key(seed: int, split_no: Column, sample_id: Column) -> Column:
    return F.md5(F.concat((F.lit(seed) + split_no).cast("string"), F.lit(":"), F.coalesce(sample_id.cast("string"), F.lit(""))))


def _cuts(samples: DataFrame, splits: list[int], ratio: float, seed: int) -> dict[int, Row]:
    """Each split's last member (``h, sample_id``), how often it is there and how many of these copies are members; a row a split."""
    numbers = F.explode(F.array(*(F.lit(s) for s in splits)))
    rows = samples.select("sample_id", numbers.alias("split_no"))
    rows = rows.withColumn("h", order_key(seed, F.col("split_no"), F.col("sample_id"))).withColumn("g", F.substring("h", 1, 4))
    counts = rows.groupBy("split_no", "g").count()
    upto = Window.partitionBy("split_no").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("count").over(Window.partitionBy("split_no"))
    groups = counts.select("split_no", "g", "count", F.sum("count").over(upto).alias("upto"), F.least(whole, F.floor(whole * F.lit(float(ratio)))).alias("members"))
    groups = groups.withColumn("rest", F.col("members") - F.col("upto") + F.col("count")).where("rest > 0 and rest <= count")
    edge = rows.join(F.broadcast(groups.select("split_no", "g", "rest")), ["split_no", "g"])  # a group a split
    edge = edge.groupBy("split_no", "rest", "h", "sample_id").agg(F.count("*").alias("copies"))
    upto = Window.partitionBy("split_no").orderBy("h", F.asc_nulls_last("sample_id")).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("inside", F.col("rest") - F.sum("copies").over(upto) + F.col("copies")).where("inside > 0 and inside <= copies")
    return {r["split_no"]: r for r in edge.collect()}


def assign(samples: DataFrame, splits: list[int], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """``split_no, sample_id, is_member`` for every sample and split; a null id is ordered as an empty one, after it."""
    kind = samples.schema["sample_id"].dataType
    cuts = _cuts(samples, splits, ratio, seed) if splits else {}
    shared = {s: r for s, r in cuts.items() if r["inside"] < r["copies"]}  # copies of one id, not all of them members

    def cut(s: int) -> Column:
        h, sample_id = (cuts[s]["h"], cuts[s]["sample_id"]) if s in cuts else ("", None)
        return F.struct(F.lit(s).alias("split_no"), F.lit(h).alias("h"), F.lit(sample_id).cast(kind).alias("id"))

    cut_kind = StructType([StructField("split_no", IntegerType()), StructField("h", StringType()), StructField("id", kind)])
    listed = F.array(*map(cut, splits)) if splits else F.array().cast(ArrayType(cut_kind))
    rows = samples.select("sample_id", F.explode(listed).alias("cut"))
    rows = rows.select("cut.split_no", "sample_id", "cut.h", "cut.id", order_key(seed, F.col("cut.split_no"), F.col("sample_id")).alias("own"))
    at = (F.col("own") == F.col("h")) & F.col("sample_id").eqNullSafe(F.col("id"))
    before = (F.col("own") == F.col("h")) & F.col("sample_id").isNotNull() & F.coalesce(F.col("sample_id") < F.col("id"), F.lit(True))
    if shared:
        rows = rows.where(~(F.col("split_no").isin([*shared]) & at))
    out = rows.select("split_no", "sample_id", ((F.col("own") < F.col("h")) | before | at).alias("is_member"))
    for s, r in shared.items():
        copies = samples.sparkSession.range(r["copies"])
        out = out.union(copies.select(F.lit(s), F.lit(r["sample_id"]).cast(kind), F.col("id") < r["inside"]))
    return out


def members(samples: DataFrame, splits: DataFrame, split_no: int) -> DataFrame:
    """Rows whose id the split lists as a member."""
    ids = splits.where((F.col("split_no") == split_no) & F.col("is_member")).select("sample_id")
    return samples.join(ids.hint("merge"), "sample_id", "left_semi")  # nearly as many as samples: not broadcast


def outside(samples: DataFrame, test_ids: DataFrame) -> DataFrame:
    """k-fold form: rows whose id is not in the fold's test list."""
    return samples.join(test_ids.select("sample_id"), "sample_id", "left_anti")


def membership(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """``split_no, sample_id, y_member``: 0 for listed test rows, 1 for listed members; unlisted rows are left out."""
    return samples.select("sample_id").join(splits, "sample_id").select("split_no", "sample_id", F.col("is_member").cast("int").alias("y_member"))


def counts(splits: DataFrame, *keys: str) -> DataFrame:
    y = F.col("is_member").cast("long")
    return splits.groupBy(*keys).agg(F.sum(y).alias("n_member"), F.sum(1 - y).alias("n_nonmember"))


def roles(spark: SparkSession, k: int, q: int) -> DataFrame:
    """``split_no, role``: 1..floor(0.7 k) train (one at least), the rest of k validate, k+1..k+q hold out.

    One training shadow serves as its own validation.
    """
    last = max(1, int(k * 0.7))
    n = F.col("split_no")
    role = F.when(n <= last, "train").when(n <= k, "val").otherwise("holdout")
    return spark.range(1, k + q + 1).select(F.col("id").cast("int").alias("split_no")).withColumn("role", role)


def capped(k: int, q: int, available: int) -> tuple[int, int]:
    """Shadows for training and holdout where only ``available`` synthetic tables exist."""
    if k + q <= available:
        return k, q
    q = max(1, q - (k + q - available))
    return available - q, q


def capped_roles(present: DataFrame, k: int, q: int) -> DataFrame:
    """Roles of the splits that have a synthetic table."""
    n = present.select("split_no").distinct().count()
    return roles(present.sparkSession, *capped(k, q, n)).join(present.select("split_no").distinct(), "split_no", "left_semi")


def missing(required: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Required keys that are not present."""
    keys = keys or ("split_no",)
    return required.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")
