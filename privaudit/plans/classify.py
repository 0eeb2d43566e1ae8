"""Membership classifiers on loss features: a forest, or a network chosen by validation TPR."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit.operators import metrics
from privaudit.operators.statistics import wide_lists, wide_matrix
from privaudit.sources import stages


def summaries(X: np.ndarray, levels: int, draws: int, more: int = 0) -> np.ndarray:
    """``arrays.summaries`` of many rows, added up in the same order, and ``more`` columns that follow the draws."""
    out, columns = [], np.ascontiguousarray(X.T[: levels * draws + more])
    for level in range(levels):
        part = columns[level * draws : (level + 1) * draws]
        mean, spread = np.zeros(len(X)), np.zeros(len(X))
        for x in part:
            mean += x
        mean /= draws
        for x in part:
            spread += (x - mean) * (x - mean)
        out += [mean, np.sqrt(spread / draws), part.min(axis=0), part.max(axis=0)]
    return np.column_stack([*out, *columns[levels * draws :]])


def prepared(features: DataFrame, cfg) -> DataFrame:
    """Raw losses, or four numbers per level (temperature) followed by the divergences."""
    wide = features.withColumn("features", F.col("features").cast("array<double>"))
    if not cfg.summary:
        return wide
    levels = len(cfg.levels if cfg.family == "diffusion" else cfg.temperatures)
    draws, more, at = cfg.draws, cfg.latent_dim if cfg.family == "latent" else 0, wide.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                yield part.set_column(at, part.schema.names[at], wide_lists(summaries(wide_matrix(part.column(at)), levels, draws, more)))

    return wide.mapInArrow(run, wide.schema)


class Classifier:
    """A fitted model and, for the network, its standardiser."""

    def __init__(self, model, scaler=None):
        self.model, self.scaler = model, scaler

    def scores(self, features: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of membership."""
        df = features.withColumn("_x", array_to_vector("features"))
        if self.scaler is not None:
            df = self.scaler.transform(df)
        out = self.model.transform(df)
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_x", "_z", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.scaler is not None:
            self.scaler.write().overwrite().save(f"{path}/scaler")
        SparkSession.active().range(1).write.mode("overwrite").parquet(f"{path}/done")


def saved(spark: SparkSession, path: str) -> bool:
    """Whether a classifier has been saved at ``path``, to its end."""
    return stages.exists(spark, f"{path}/done")


def load(path: str, kind: str) -> Classifier:
    if kind == "rf":
        return Classifier(RandomForestClassificationModel.load(f"{path}/model"))
    return Classifier(MultilayerPerceptronClassificationModel.load(f"{path}/model"), StandardScalerModel.load(f"{path}/scaler"))


def train(training: DataFrame, validation: DataFrame, cfg) -> Classifier:
    """Fit on ``features, y_member``; the network keeps the first round with the best validation TPR."""
    df = training.select(array_to_vector("features").alias("_x"), F.col("y_member").cast("double").alias("y_member"))
    if cfg.classifier == "rf":
        return Classifier(RandomForestClassifier(featuresCol="_x", labelCol="y_member", seed=cfg.seed, **cfg.rf).fit(df))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(df)
    scaled = stages.written(scaler.transform(df).select("_z", "y_member"), "standardised")
    width = len(scaled.first()["_z"])
    best, weights = (-1.0, None), None
    for _ in range(cfg.rounds):
        mlp = MultilayerPerceptronClassifier(featuresCol="_z", labelCol="y_member", layers=[width, cfg.hidden, cfg.hidden, 2], maxIter=10, seed=cfg.seed)
        if weights is not None:
            mlp.setInitialWeights(weights)
        model = mlp.fit(scaled)
        weights = model.weights
        found = Classifier(model, scaler)
        scored = found.scores(validation).select("sample_id", "score", F.col("y_member").alias("y"))
        tpr = metrics.tpr_at_fpr(scored.withColumn("all", F.lit(1)), ["all"], cfg.target_fpr).first()["tpr_at_fpr"]
        if tpr > best[0]:
            best = (tpr, found)
    return best[1]
