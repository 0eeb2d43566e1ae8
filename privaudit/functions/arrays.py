"""Array expressions: one-hot codes, level slices and their summaries, output transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)))


def decode_one_hot(code: Column) -> Column:
    """The position of the largest entry."""
    return (F.array_position(code, F.array_max(code)) - 1).cast("int")


def level(losses: Column, index: int, draws: int) -> Column:
    """The draws of one level of a level-major array."""
    return F.slice(losses, index * draws + 1, draws)


def summaries(losses: Column, levels: int, draws: int) -> Column:
    """Mean, population deviation, least and largest of each level, level by level."""

    def four(index: int) -> Column:
        part = F.transform(level(losses, index, draws), lambda x: x.cast("double"))
        mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / draws
        spread = F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / draws
        return F.array(mean, F.sqrt(spread), F.array_min(part), F.array_max(part))

    return F.flatten(F.array(*(four(i) for i in range(levels))))


def kl_terms(mean: Column, log_variance: Column) -> Column:
    """Per-dimension divergence from N(0, 1)."""
    return F.zip_with(mean, log_variance, lambda m, v: F.lit(-0.5) * (F.lit(1.0) + v - m * m - F.exp(v)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def output_transform(values: Column, kind: str) -> Column:
    apply = {
        "none": lambda x: x,
        "exp": F.exp,
        "sigmoid": lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
        "relu": lambda x: F.greatest(x, F.lit(0.0)),
    }[kind]
    return F.transform(values, apply)
