"""Second moments on Spark; only feature-by-feature matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector(cols: list[str]) -> Column:
    """Wide feature columns as one array column."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def dense(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without a Python object per row."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def stack(s: pd.Series) -> np.ndarray:
    return np.vstack(s.to_numpy()) if len(s) else np.empty((0, 0))


def gram(df: DataFrame, vec: str, dim: int, shift: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and X'X of an array column, reduced per partition first.

    ``shift`` is subtracted from every row to keep the products well conditioned.
    """
    offset = np.zeros(dim) if shift is None else np.asarray(shift, dtype=float)
    upper = np.triu_indices(dim)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = dense(batch.column(vec)) - offset
                n += len(x)
                s += x.sum(axis=0)
                g += x.T @ x
        if n:
            i = np.concatenate([[-1], np.full(dim, -1), upper[0]])
            j = np.concatenate([[-1], np.arange(dim), upper[1]])
            value = np.concatenate([[n], s, g[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(value)], names=["i", "j", "value"])

    parts = df.select(vec).mapInArrow(partial, "i int, j int, value double")
    total = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    n = int(round(total.loc[(total.i < 0) & (total.j < 0), "value"].sum()))
    s, g = np.zeros(dim), np.zeros((dim, dim))
    sums = total[(total.i < 0) & (total.j >= 0)]
    s[sums.j.to_numpy()] = sums.value.to_numpy()
    cells = total[total.i >= 0]
    g[cells.i.to_numpy(), cells.j.to_numpy()] = cells.value.to_numpy()
    g = g + np.triu(g, 1).T
    return n, s, g


def covariance(df: DataFrame, vec: str, dim: int, ddof: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and covariance matrix in one pass over the rows.

    A few rows give a rough centre; it only conditions the products and cancels out.
    """
    head = [r[0] for r in df.select(vec).limit(200).collect()]
    center = np.mean(np.array(head, dtype=float), axis=0) if head else np.zeros(dim)
    n, s, g = gram(df, vec, dim, center)
    d = s / max(n, 1)
    return n, center + d, (g - n * np.outer(d, d)) / max(n - ddof, 1)


def project(vec: str, weights: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """(x - mean) W as an array column."""
    w = np.asarray(weights, dtype=float)
    m = np.zeros(w.shape[0]) if mean is None else np.asarray(mean, dtype=float)
    from pyspark.sql.types import ArrayType, DoubleType

    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list((stack(x) - m) @ w)) if len(x) else pd.Series([], dtype=object)

    return apply(F.col(vec))
