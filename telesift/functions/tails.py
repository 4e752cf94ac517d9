"""Tail probabilities for the report-sized test tables (one value per comparison)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """P(Z >= z) of the standard normal distribution."""
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2.0)))


def _t_sf(t: float, df: float) -> float:
    """P(T >= t): continued fraction of the regularised incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if t == 0:
        return 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def fraction(x, a, b):
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= c * d
            if abs(c * d - 1.0) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        tail = front * fraction(x, a, b) / a
    else:
        tail = 1.0 - front * fraction(1 - x, b, a) / b
    return tail / 2 if t > 0 else 1 - tail / 2


@F.pandas_udf(DoubleType())
def student_t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T >= t) of Student's t distribution."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else _t_sf(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")
