"""Normal quantile function as a column, and the distribution function in NumPy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), constant term first.
A = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
B = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
C = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640)
D = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9)
E = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7)
F_ = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15)

#: What transformed values are clipped to.
CLIP = 5.199337582605575


def _horner(x, coefficients):
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution, clipped to +-CLIP."""
    q = p - F.lit(0.5)
    r0 = F.lit(0.180625) - q * q
    column = lambda x, cs: _horner(x, tuple(F.lit(float(c)) for c in cs))
    centre = q * column(r0, A) / column(r0, B)
    r = F.sqrt(-F.log(F.least(F.greatest(F.when(q < 0, p).otherwise(F.lit(1.0) - p), F.lit(1e-300)), F.lit(1.0))))
    near, far = r - F.lit(1.6), r - F.lit(5.0)
    tail = F.when(r <= 5.0, column(near, C) / column(near, D)).otherwise(column(far, E) / column(far, F_))
    value = F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return F.greatest(F.least(value, F.lit(CLIP)), F.lit(-CLIP))


def ppf_array(p: np.ndarray) -> np.ndarray:
    """The same for an array."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    q = p - 0.5
    r0 = 0.180625 - q * q
    r = np.sqrt(-np.log(np.where(q < 0, p, 1.0 - p)))
    tail = np.where(r <= 5.0, _horner(r - 1.6, C) / _horner(r - 1.6, D), _horner(r - 5.0, E) / _horner(r - 5.0, F_))
    out = np.where(np.abs(q) <= 0.425, q * _horner(r0, A) / _horner(r0, B), np.where(q < 0, -tail, tail))
    return np.clip(out, -CLIP, CLIP)


def cdf_array(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(x)
