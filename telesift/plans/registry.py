"""Catalogue of the registered queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of the rounding that every registered query applies to its doubles."""
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0"


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    scale = F.lit(float(10**digits))
    return df.select(
        *[
            (F.rint(F.col(c).cast("double") * scale) / scale + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = " ".join(sql.split()) if "--" not in sql else sql
        return fn

    return register
