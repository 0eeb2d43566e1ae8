"""Reproducible uniform and normal numbers from MD5, and the noise schedule.

A uniform number is (h + 0.5) / 2**52 with h the first 13 hex digits of a text's
MD5; a normal number is the Box-Muller cosine of two of them.  The column and the
NumPy forms agree, so SQL can check either.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, BETA_FIRST, BETA_LAST = 1000, 0.001, 0.02


def uniform(text: Column) -> Column:
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column) -> Column:
    """N(0, 1) for each combination of the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    u1, u2 = uniform(F.concat(text, F.lit(":1"))), uniform(F.concat(text, F.lit(":2")))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _uniform(text: str) -> float:
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def normal_value(seed: int, *keys: object) -> float:
    text = ":".join([str(seed), *map(str, keys)])
    return math.sqrt(-2.0 * math.log(_uniform(text + ":1"))) * math.cos(2 * math.pi * _uniform(text + ":2"))


def bank(seed: int, draws: int, dim: int) -> np.ndarray:
    """The noise bank: the same draws for all rows, splits and shadows."""
    return np.array([[normal_value(seed, n, d) for d in range(dim)] for n in range(draws)]).reshape(draws, dim)


def alpha_bar(steps: int = STEPS) -> np.ndarray:
    """Inclusive products of 1 - beta, beta linear from 0.001 to 0.02."""
    beta = BETA_FIRST + np.arange(steps) * (BETA_LAST - BETA_FIRST) / (STEPS - 1)
    return np.cumprod(1.0 - beta)
