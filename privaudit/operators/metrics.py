"""Ranking metrics per group, from counts per score.

Scores are reduced to counts of members and non-members per distinct score, and
running counts come from two phases: inside score ranges, and over the ranges'
totals.  No task holds a whole group, however few groups there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGES = 64


def ranged(df: DataFrame, column: str, ranges: int = _RANGES) -> DataFrame:
    """Adds ``part``, the range of ``column`` a row lies in; the cuts come from approximate quantiles."""
    cuts = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10000).alias("c")).first()["c"]
    edges = sorted({float(c) for c in cuts or []})
    part = F.size(F.filter(F.array(*(F.lit(c) for c in edges)), lambda c: c < F.col(column))) if edges else F.lit(0)
    return df.withColumn("part", part.cast("int"))


def running(df: DataFrame, keys: list[str], order: list[Column], part_order: Column, sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Running sums over each group in the given order; ``df`` has ``part`` in line with it."""
    totals = df.groupBy(*keys, "part").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    before = Window.partitionBy(*keys).orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "part", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    inner = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = df.join(starts, [*keys, "part"])
    return joined.select(*df.columns, *((F.col(f"_{k}") + F.coalesce(F.sum(v).over(inner), F.lit(0))).alias(k) for k, v in sums.items()))


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """ROC AUC by average ranks (``score, y``); NaN if a group has one class only."""
    by_score = scores.groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    below = running(ranged(by_score, "score"), keys, [F.asc("score")], F.asc("part"), {"neg_below": "neg"}, inclusive=False)
    sums = below.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    value = F.when((F.col("p") == 0) | (F.col("n") == 0), F.lit(float("nan"))).otherwise(F.col("wins") / (F.col("p").cast("double") * F.col("n")))
    return sums.select(*keys, value.alias("auc"))


def tpr_at_fpr(scores: DataFrame, keys: list[str], target: float = 0.10) -> DataFrame:
    """Highest TPR among row cuts with FPR at most ``target``; rows by score down, then ``sample_id``; 0 if a class is missing.

    Counts per score decide but for the one score at which a group passes the
    target; its rows are counted in ``sample_id`` order, over ranges of ids.
    """
    by_score = scores.groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    ranks = running(ranged(by_score, "score"), keys, [F.desc("score")], F.desc("part"), {"tp": "pos", "fp": "neg"})
    totals = by_score.groupBy(*keys).agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    joined = ranks.join(F.broadcast(totals), keys) if keys else ranks.crossJoin(F.broadcast(totals))  # a row per group
    within = lambda fp: F.when(F.col("n") > 0, fp / F.col("n") <= F.lit(target)).otherwise(False)
    fits = within(F.col("fp"))
    passing = F.max(F.when(~fits, F.struct("score", (F.col("tp") - F.col("pos")).alias("tp0"), (F.col("fp") - F.col("neg")).alias("fp0"))))
    groups = joined.groupBy(*keys).agg(F.max("p").alias("p"), F.max("n").alias("n"), F.max(F.when(fits, F.col("tp"))).alias("whole"), passing.alias("at"))
    at = groups.select(*keys, F.col("at.score").alias("score"), "at.tp0", "at.fp0", "n").where("score is not null")
    tied = scores.join(F.broadcast(at), [*keys, "score"]).select(*keys, "sample_id", "tp0", "fp0", "n", F.col("y").cast("long").alias("y"), (1 - F.col("y")).cast("long").alias("not_y"))
    tied = tied.repartitionByRange(*keys, "sample_id").withColumn("part", F.spark_partition_id())
    cuts = running(tied, keys, [F.asc("sample_id")], F.asc("part"), {"tp": "y", "fp": "not_y"})
    inner = cuts.where(within(F.col("fp0") + F.col("fp"))).groupBy(*keys).agg(F.max(F.col("tp0") + F.col("tp")).alias("inner"))
    best = groups.join(F.broadcast(inner), keys, "left") if keys else groups.crossJoin(F.broadcast(inner))
    value = F.when((F.col("p") > 0) & (F.col("n") > 0), F.greatest(F.coalesce("whole", F.lit(0)), F.coalesce("inner", F.lit(0))) / F.col("p"))
    return best.select(*keys, F.coalesce(value, F.lit(0.0)).alias("tpr_at_fpr"))


def accuracy(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows where ``score > 0.5`` equals the label; class counts."""
    right = ((F.col("score") > 0.5).cast("int") == F.col("y")).cast("double")
    return scores.groupBy(*keys).agg(F.avg(right).alias("acc"), F.sum("y").cast("long").alias("n_member"), F.sum(1 - F.col("y")).cast("long").alias("n_nonmember"))


def evaluate(scores: DataFrame, keys: list[str], target: float = 0.10) -> DataFrame:
    """All metrics of each group."""
    return accuracy(scores, keys).join(auc(scores, keys), keys).join(tpr_at_fpr(scores, keys, target), keys)


def report(metrics: DataFrame) -> DataFrame:
    """Per-split rows and, with a null ``split_no``, the average of each (trained_on, source)."""
    columns = [F.col(c) for c in ("trained_on", "source", "split_no")]
    return metrics.groupingSets([columns, columns[:2]], *columns).agg(*(F.avg(m).alias(m) for m in ("auc", "tpr_at_fpr", "acc")))


def domain_gap(metrics: DataFrame) -> DataFrame:
    """Per classifier: average on real-shadow features minus average on synthetic-shadow features."""
    means = metrics.groupBy("trained_on").agg(*(F.avg(F.when(F.col("source") == s, F.col(m))).alias(f"{s}_{m}") for s in ("real", "synth") for m in ("auc", "tpr_at_fpr")))
    return means.select("trained_on", *((F.col(f"real_{m}") - F.col(f"synth_{m}")).alias(f"{m}_gap") for m in ("auc", "tpr_at_fpr")))


def best_step(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The first ``step`` that reaches a group's highest ``tpr``."""
    return candidates.groupBy(*keys).agg(F.min_by("step", F.struct(-F.col("tpr"), F.col("step"))).alias("step"), F.max("tpr").alias("tpr"))
