"""Stage tables: Parquet partitioned by their keys, recomputed only where missing or stale."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only where the master is this machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="privaudit-")
    return f"{base.rstrip('/')}/audit/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def read(spark: SparkSession, path: str, split_no: int | None = None, hint: str = "") -> DataFrame:
    """A stage table, or one split of it; a missing one is an error with a hint."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no table at {path}. {hint}".strip())
    df = spark.read.parquet(path)
    if split_no is not None:
        df = df.where(F.col("split_no") == split_no)
        if df.isEmpty():
            raise FileNotFoundError(f"no split {split_no} at {path}. {hint}".strip())
    return df


def write(df: DataFrame, path: str, keys: tuple[str, ...] = ("split_no",)) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def by_split(spark: SparkSession, prints: Mapping[int, str]) -> DataFrame:
    """``split_no, fingerprint``: a row a split."""
    return spark.createDataFrame([*prints.items()], "split_no int, fingerprint string")


def ensure(spark: SparkSession, path: str, required: list[int], fingerprint: str | Mapping[int, str], compute: Callable[[list[int]], DataFrame], force: bool = False) -> list[int]:
    """Compute the splits that are missing or have another fingerprint (one for all, or one a split); returns those numbers."""
    prints = {s: fingerprint if isinstance(fingerprint, str) else fingerprint[s] for s in required}
    fresh: set[int] = set()
    if not force and exists(spark, path):
        known = spark.read.parquet(path).select("split_no", "fingerprint").distinct().collect()  # some rows a split
        fresh = {r["split_no"] for r in known if prints.get(r["split_no"]) == r["fingerprint"]}
    todo = [s for s in required if s not in fresh]
    if todo:
        write(compute(todo).join(F.broadcast(by_split(spark, {s: prints[s] for s in todo})), "split_no"), path)
    return todo
