"""Normal, chi-square and Student tails for small result tables."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _bisect(increasing, target: float, low: float, high: float) -> float:
    for _ in range(200):
        middle = 0.5 * (low + high)
        if increasing(middle) < target:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)


def normal_quantile(p: float) -> float:
    return _bisect(normal_cdf, p, -40.0, 40.0)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 1000):
        coefficient = -i * (i - a)
        b += 2
        d = 1.0 / (coefficient * d + b or tiny)
        c = b + coefficient / c or tiny
        step = d * c
        value *= step
        if abs(step - 1) < 1e-15:
            break
    return value * scale


def chi2_sf(statistic: float, df: float) -> float:
    if not math.isfinite(statistic) or df <= 0:
        return float("nan")
    return gamma_upper(df / 2.0, statistic / 2.0)


def student_cdf(t: float, df: int) -> float:
    """Exact finite series for integer degrees of freedom."""
    theta = math.atan(t / math.sqrt(df))
    cosine, sine = math.cos(theta), math.sin(theta)
    if df % 2:
        term, total = cosine, (cosine if df > 1 else 0.0)
        for k in range(3, df, 2):
            term *= cosine * cosine * (k - 1) / k
            total += term
        return 0.5 + (theta + sine * total) / math.pi
    term = total = 1.0
    for k in range(2, df, 2):
        term *= cosine * cosine * (k - 1) / k
        total += term
    return 0.5 + 0.5 * sine * total


def student_quantile(p: float, df: int) -> float:
    return _bisect(lambda t: student_cdf(t, df), p, -1e6, 1e6)


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v)).astype("float64")


@pandas_udf(DoubleType())
def normal_upper_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else 1.0 - normal_cdf(v)).astype("float64")


@pandas_udf(DoubleType())
def student_t975(df: pd.Series) -> pd.Series:
    return df.map(lambda v: None if pd.isna(v) or v < 1 else student_quantile(0.975, int(v))).astype("float64")


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p; for result tables of bounded size only."""
    return normal_p(z.cast("double"))


# task code travels with the job; executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
