"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def filled(c) -> Column:
    """Missing and NaN values become 0 (no traffic)."""
    x = col(c).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def finite_or_null(c) -> Column:
    x = col(c)
    return F.when(F.abs(x) < F.lit(INF), x)


def signed_log(c) -> Column:
    x = col(c)
    return F.signum(x) * F.log1p(F.abs(x))


def safe_div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(col(b) != 0, col(a) / col(b))


def total(cols: Iterable[Column]) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + c
    return out


def feature_stats(
    df: DataFrame,
    features: list[str],
    stats: Mapping[str, Callable[[str], Column]],
    by: Iterable[str] = (),
) -> DataFrame:
    """One wide aggregate over all features, returned as (by.., pos, feature, stats..).

    The rows are reduced before they are turned to long form, so the long table has
    one row per group and feature whatever the size of the input.
    """
    by = list(by)
    aggs = [fn(f).alias(f"{name}__{i}") for i, f in enumerate(features) for name, fn in stats.items()]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(f).alias("feature"),
            *[F.col(f"{name}__{i}").alias(name) for name in stats],
        )
        for i, f in enumerate(features)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def ln_factorial(n: Column) -> Column:
    """ln(n!) as an expression: the Stirling series at n + 9, shifted back by eight factors (error < 1e-12)."""
    x = n.cast("double")
    z = x + 9
    w = F.lit(1.0) / z
    w2 = w * w
    series = (
        (z - 0.5) * F.log(z)
        - z
        + F.lit(0.9189385332046727)  # ln(2 pi) / 2
        + w * (F.lit(1 / 12) - w2 * (F.lit(1 / 360) - w2 * (F.lit(1 / 1260) - w2 * (F.lit(1 / 1680) - w2 / 1188))))
    )
    shift = x + 1
    for i in range(2, 9):
        shift = shift * (x + i)
    return series - F.log(shift)


def stirling_error(n: Column) -> Column:
    """ln(n!) minus Stirling's formula, for n > 0."""
    x = n.cast("double")
    r = F.lit(1.0) / x
    r2 = r * r
    series = r * (F.lit(1 / 12) - r2 * (F.lit(1 / 360) - r2 * (F.lit(1 / 1260) - r2 * (F.lit(1 / 1680) - r2 / 1188))))
    return F.when(x > 15, series).otherwise(ln_factorial(n) - (x + 0.5) * F.log(x) + x - 0.9189385332046727)


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, from the relative gap, so that nothing large cancels."""
    gap = (x - mean) / mean
    return mean * ((gap + 1) * F.log1p(gap) - gap)


def log_binomial(x: Column, n: Column, p: Column) -> Column:
    """ln of the binomial law in saddle-point form, for 0 < p < 1."""
    x, n = x.cast("double"), n.cast("double")
    y, q = n - x, F.lit(1.0) - p
    inner = (
        stirling_error(n) - stirling_error(x) - stirling_error(y) - deviance(x, n * p) - deviance(y, n * q)
        + F.log(n / (F.lit(6.283185307179586) * x * y)) / 2
    )
    return F.when(x == 0, n * F.log1p(-p)).when(y == 0, n * F.log(p)).otherwise(inner)


def log_hypergeometric(x: Column, a: Column, b: Column, t: Column) -> Column:
    """ln P(overlap = x) of random subsets of a and b out of t elements, for 0 < b < t; no large factorials are formed."""
    p = b.cast("double") / t
    return log_binomial(x, a, p) + log_binomial(b - x, t - a, p) - log_binomial(b, t, p)


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other, so no row is lost."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])
