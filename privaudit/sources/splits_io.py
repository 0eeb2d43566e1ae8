"""Split tables: JSON objects, k-fold objects and Parquet, append-only by split number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit.operators import splits
from privaudit.sources.stages import ensure

CUSTOM = "map<string,struct<train_ids:array<string>,test_ids:array<string>>>"
KFOLD = "struct<splits:map<string,struct<train_index:array<string>,test_index:array<string>>>>"


def to_json(table: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One ``json`` row: ``{"split_1": {"train_ids": [...], "test_ids": [...]}}``.

    The ids stand in the order of the samples' ``ordinal``, or sorted if no ``samples`` are given.
    """
    name = F.col("sample_id").cast("string")
    if samples is not None:
        table = table.join(samples.select("sample_id", "ordinal"), "sample_id")
    item = F.struct(*([F.col("ordinal")] if samples is not None else []), name.alias("id"))
    ids = lambda member: F.transform(F.sort_array(F.collect_list(F.when(F.col("is_member") == member, item))), lambda x: x["id"])
    per = table.groupBy("split_no").agg(ids(F.lit(True)).alias("train_ids"), ids(F.lit(False)).alias("test_ids"))
    entry = F.struct(F.concat(F.lit("split_"), F.col("split_no").cast("string")).alias("key"), F.struct("train_ids", "test_ids").alias("value"))
    return per.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("json"))


def _long(entries: DataFrame, train: Column, test: Column, split_set: str) -> DataFrame:
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("split_no")
    parts = [entries.select(number, F.explode(ids).alias("sample_id"), F.lit(member).alias("is_member")) for ids, member in ((train, True), (test, False))]
    return parts[0].union(parts[1]).select(F.lit(split_set).alias("split_set"), "split_no", "sample_id", "is_member")


def from_json(text: DataFrame) -> DataFrame:
    """``split_set, split_no, sample_id, is_member`` of rows with custom splits in ``json``."""
    entries = text.select(F.explode(F.from_json("json", CUSTOM)).alias("key", "value"))
    return _long(entries, F.col("value.train_ids"), F.col("value.test_ids"), "custom")


def from_kfold_json(text: DataFrame) -> DataFrame:
    """The same of k-fold objects."""
    entries = text.select(F.explode(F.from_json("json", KFOLD)["splits"]).alias("key", "value"))
    return _long(entries, F.col("value.train_index"), F.col("value.test_index"), "kfold")


def read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    if form == "parquet":
        return spark.read.parquet(path)
    text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
    return from_json(text) if form == "json" else from_kfold_json(text)


def ids_print(samples: DataFrame) -> str:
    """A fingerprint of the sample ids, whatever their order."""
    n, total = samples.agg(F.count("*"), F.sum(F.xxhash64(F.col("sample_id").cast("string")).cast("decimal(20,0)"))).first()
    return f"{n}-{total or 0}"


def extend(samples: DataFrame, path: str, required: list[int], ratio: float, seed: int, force: bool = False) -> list[int]:
    """Write the splits that the table at ``path`` lacks or that were made from other ids; returns their numbers."""
    return ensure(samples.sparkSession, path, required, f"{ids_print(samples)}-{ratio}-{seed}", lambda numbers: splits.assign(samples, numbers, ratio, seed), force)
