"""Shared-folder scratch tables.

Intermediate tables go to the folder the session names in
``spark.checkpoint.dir``: every executor and the driver can read it, so a lost
executor costs a re-read and never a re-computation.  Where the setting is absent
and the master is local (one machine), a temporary folder takes its place; on a
cluster that is an error, since no other machine would see such a folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = _local_base(spark)
    return f"{base.rstrip('/')}/privaudit/{name}-{uuid.uuid4().hex[:12]}"


_LOCAL: dict[str, str] = {}


def _local_base(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="privaudit-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage the way ``checkpoint()`` does, but evaluates ``df`` once
    and keeps column pruning for what follows.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession) -> int:
    """The session's shuffle partition count, which the cluster sets by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key counts as hot above so many rows, or above this share of all rows.
_HOT_ROWS, _HOT_SHARE = 1024, 100_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which has each value of ``keys`` once, so that no hot key meets in one task.

    Hot keys are counted first: those with more than ``_HOT_ROWS`` rows and more
    than one ``_HOT_SHARE``-th of all rows, so there are at most ``_HOT_SHARE`` of
    them.  Their rows of ``right`` are broadcast, all others are joined by
    shuffle.  ``left`` is read three times: a written table.  ``how``: inner or left.
    ``counts`` (the keys and ``count``), where the rows of each key of ``right`` have been counted before.
    """
    least = max(_HOT_ROWS, left.count() // _HOT_SHARE)
    if counts is None:
        counts = left.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).count()
    hot = materialize(counts.where(F.col("count") > least).select(*keys), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    return marked.where("__hot").drop("__hot").join(few, keys, how).unionByName(marked.where("__hot is null").drop("__hot").join(right, keys, how))


def about(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df``, those with the smallest hashes of ``keys``; all rows if there are fewer.

    One count and a filter: nothing is sorted or gathered.  The number of rows
    follows a binomial law, so it stays within some per cent of ``rows``.
    """
    n = df.count()
    if n <= rows:
        return df
    share = F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.where(share < F.lit(rows / n))
