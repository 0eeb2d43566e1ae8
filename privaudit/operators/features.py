"""Loss features in long form, and the check for stale feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_losses(features: DataFrame, draws: int, keys: list[str]) -> DataFrame:
    """``keys, level_idx, noise_idx, loss`` of level-major arrays."""
    rows = features.select(*keys, F.posexplode("features").alias("i", "loss"))
    return rows.select(*keys, F.floor(F.col("i") / draws).cast("int").alias("level_idx"), (F.col("i") % draws).alias("noise_idx"), F.col("loss").cast("double").alias("loss"))


def summarise(losses: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation, least and largest loss per row and level."""
    return losses.groupBy(*keys, "level_idx").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"), F.min("loss").alias("min"), F.max("loss").alias("max"))


def stale(features: DataFrame, width: int, fingerprint: str | None = None) -> DataFrame:
    """Rows whose width, or fingerprint, is not what the settings ask for."""
    bad = F.size("features") != width
    if fingerprint is not None:
        bad = bad | F.coalesce(F.col("fingerprint") != fingerprint, F.lit(True))
    return features.where(bad)


def checked(samples: DataFrame) -> DataFrame:
    """The samples, failing on a null or NaN feature."""
    fine = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x))
    return samples.where(F.assert_true(fine, F.lit("a feature is null or NaN")).isNull())
