"""Augmented views and label-free representations.

Every draw is a hash of (seed, row, view, feature), so a view is a plain projection: no
shuffle, no state, and the same numbers after a retry.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from telesift.functions.exprs import feature_stats, total
from telesift.functions.hashing import digest, draws, uniform
from telesift.functions.linalg import covariance, gram, project, stack

MODES = ("group", "independent", "none")


def _key(id_col: str) -> list[Column]:
    return [F.col(id_col), F.col("view")]


def expand_views(df: DataFrame, views: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """One line per row and view."""
    return df.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views])))


def _masked_groups(groups: dict[str, list[str]], seed, id_col: str, max_groups: int) -> dict[str, Column]:
    """Group -> masked?  m ~ U{0..max} groups with the smallest digests are masked."""
    m = F.floor(uniform(seed, *_key(id_col), "m") * (max_groups + 1))
    found = {g: digest(seed, *_key(id_col), g) for g in groups}
    smaller = lambda g: reduce(add, [(found[o] < found[g]).cast("int") for o in groups if o != g], F.lit(0))
    return {g: smaller(g) < m for g in groups}


def group_mask(df: DataFrame, features: list[str], groups: dict[str, list[str]], seed=42, id_col: str = "row_id", max_groups: int = 2) -> DataFrame:
    """Whole feature groups become 0; which ones is drawn per row and view."""
    flags = _masked_groups(groups, seed, id_col, max_groups)
    tmp = {g: f"_mask{i}" for i, g in enumerate(groups)}
    with_flags = df.select("*", *[c.alias(tmp[g]) for g, c in flags.items()])
    owner = {f: g for g, fs in groups.items() for f in fs}
    out = [F.when(F.col(tmp[owner[c]]), F.lit(0.0)).otherwise(F.col(c)).alias(c) if c in features and c in owner else F.col(c) for c in df.columns]
    return with_flags.select(*out)


def _cell_filter(df: DataFrame, features: list[str], p: float, kind: str, seed, id_col: str) -> DataFrame:
    """Cells become 0 where their draw of this kind is below p."""
    own = [c for c in df.columns if c in features]
    if not own:
        return df
    drawn = df.withColumn("_u", draws(seed, _key(id_col), [(c, kind) for c in own]))
    keep = {c: F.col("_u")[f"u{i}"] >= p for i, c in enumerate(own)}
    return drawn.select(*[F.when(keep[c], F.col(c)).otherwise(F.lit(0.0)).alias(c) if c in keep else F.col(c) for c in df.columns])


def _spread(df: DataFrame, features: list[str]) -> dict[str, Column]:
    """Population deviation of every column, as literals: a subquery would be read once per cell."""
    found = df.agg(*[F.stddev_pop(c).alias(c) for c in features]).first()
    return {c: F.lit(found[c]).cast("double") for c in features}


def independent_mask(df: DataFrame, features: list[str], n_groups: int, seed=42, id_col: str = "row_id", max_groups: int = 2) -> DataFrame:
    """Cells become 0 independently at the expected rate of group masking."""
    p = (max_groups / 2.0) / n_groups
    return _cell_filter(df, features, p, "i", seed, id_col)


def feature_dropout(df: DataFrame, features: list[str], p: float = 0.1, seed=42, id_col: str = "row_id") -> DataFrame:
    return _cell_filter(df, features, p, "d", seed, id_col)


def noise(df: DataFrame, features: list[str], sigma: float = 0.05, seed=42, id_col: str = "row_id", relative: bool = False) -> DataFrame:
    """Additive Gaussian noise; ``relative`` scales it by the deviation of the (masked) column."""
    own = [c for c in df.columns if c in features]
    if not own:
        return df
    sd = _spread(df, own) if relative else {}
    drawn = df.withColumn("_n", draws(seed, _key(id_col), [], [(c,) for c in own]))
    more = {c: F.lit(sigma) * F.col("_n")[f"n{i}"] for i, c in enumerate(own)}
    more = {c: x * (sd[c] + 1e-8) if relative else x for c, x in more.items()}
    return drawn.select(*[(F.col(c) + more[c]).alias(c) if c in more else F.col(c) for c in df.columns])


def two_views(
    df: DataFrame, features: list[str], groups: dict[str, list[str]], mode: str = "group", seed=42, id_col: str = "row_id",
    sigma: float = 0.05, dropout: float = 0.1,
) -> DataFrame:
    """Two views per row: noise, feature dropout, then structured, matched-rate or no masking."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: {MODES}")
    out = feature_dropout(noise(expand_views(df), features, sigma, seed, id_col), features, dropout, seed, id_col)
    if mode == "group":
        return group_mask(out, features, groups, seed, id_col)
    if mode == "independent":
        return independent_mask(out, features, len(groups), seed, id_col)
    return out


def mask_rates(df: DataFrame, groups: dict[str, list[str]], seed=42, id_col: str = "row_id", max_groups: int = 2) -> DataFrame:
    """Realised share of (row, view) pairs in which each group is masked, beside the expected one."""
    flags = _masked_groups(groups, seed, id_col, max_groups)
    wide = expand_views(df).agg(*[F.avg(c.cast("double")).alias(f"r{i}") for i, c in enumerate(flags.values())])
    rows = [F.struct(F.lit(g).alias("group"), F.col(f"r{i}").alias("rate"), F.lit((max_groups / 2.0) / len(groups)).alias("expected")) for i, g in enumerate(groups)]
    return wide.select(F.inline(F.array(*rows)))


# fixed values of the planned first-generation augmentation
MASK_RATIO, NOISE_STD, SCALE_LOW, SCALE_HIGH = 0.15, 0.05, 0.9, 1.1


def count_like(df: DataFrame, features: list[str], hint: str = "_count") -> list[str]:
    """Features named as counts or holding whole numbers only."""
    whole = feature_stats(df, features, {"whole": lambda f: F.bool_and(F.coalesce(F.col(f) == F.floor(F.col(f)), F.lit(True)))})
    return [r["feature"] for r in whole.orderBy("pos").collect() if r["whole"] or hint in r["feature"]]


def legacy_views(df: DataFrame, features: list[str], size_features: list[str], seed=42, id_col: str = "row_id") -> DataFrame:
    """Two of three transforms per (row, view): noise on continuous columns, masking, scale jitter on size columns."""
    continuous = set(features) - set(count_like(df, features))
    noisy = [c for c in features if c in continuous]
    sd = _spread(df, features)
    kinds = [("pick",), ("s",), *[(c, "i") for c in features]]
    out = expand_views(df).withColumn("_d", draws(seed, _key(id_col), kinds, [(c,) for c in noisy]))
    u = {k: F.col("_d")[f"u{i}"] for i, k in enumerate(kinds)}
    out = out.withColumn("_skip", F.floor(u["pick",] * 3))

    def cell(c: str) -> Column:
        x = F.col(c).cast("double")
        if c in continuous:
            x = F.when(F.col("_skip") == 0, x).otherwise(x + NOISE_STD * sd[c] * F.col("_d")[f"n{noisy.index(c)}"])
        gone = (F.col("_skip") != 1) & (u[c, "i"] < MASK_RATIO)
        x = F.when(gone, F.lit(0.0)).otherwise(x)
        if c in size_features:
            jitter = F.lit(SCALE_LOW) + F.lit(SCALE_HIGH - SCALE_LOW) * u["s",]
            x = F.when(F.col("_skip") == 2, x).otherwise(x * jitter)
        return x.alias(c)

    return out.select(*[cell(c) if c in features else F.col(c) for c in [*df.columns, "view"]])


# ---------------------------------------------------------------- representation


def vicreg_terms(
    va: DataFrame, vb: DataFrame, dim: int, id_col: str = "row_id", vec: str = "v",
    weights: tuple[float, float, float] = (25.0, 25.0, 1.0), eps: float = 1e-4,
) -> DataFrame:
    """Invariance, variance hinge and off-diagonal covariance of two view tables, and their weighted sum."""
    pair = va.select(id_col, F.col(vec).alias("x")).join(vb.select(id_col, F.col(vec).alias("y")), id_col)
    # one pass over the joined rows gives the covariance of both views and between them
    n, mean, c = covariance(pair.select(F.concat("x", "y").alias("z")), "z", 2 * dim)
    cx, cy, between = c[:dim, :dim], c[dim:, dim:], np.diag(c[:dim, dim:])
    gap = (np.diag(cx) + np.diag(cy) - 2 * between) * (n - 1) / n + (mean[:dim] - mean[dim:]) ** 2
    inv = float(gap.mean())
    hinge = [float(np.maximum(0.0, 1.0 - np.sqrt(np.diag(m) + eps)).mean()) for m in (cx, cy)]
    off = [float((m**2).sum() - (np.diag(m) ** 2).sum()) / dim for m in (cx, cy)]
    var, cov = sum(hinge) / 2, sum(off) / 2
    loss = weights[0] * inv + weights[1] * var + weights[2] * cov
    return va.sparkSession.createDataFrame([(float(inv), var, cov, float(loss))], "invariance double, variance double, covariance double, loss double")


def spectral_encoder(va: DataFrame, vb: DataFrame, dim: int, out: int, id_col: str = "row_id", vec: str = "v", ridge: float = 1e-6) -> dict:
    """Linear map with unit-variance, uncorrelated outputs on which the two views agree most.

    Spark reduces the rows to the covariance of the views and the second moments of their
    differences; the generalised eigenproblem of these two d x d matrices is solved locally.
    """
    pair = va.select(id_col, F.col(vec).alias("x")).join(vb.select(id_col, F.col(vec).alias("y")), id_col)
    both = pair.select(F.explode(F.array("x", "y")).alias("z"))
    _, mean, c = covariance(both, "z", dim)
    n, _, g = gram(pair.select(F.zip_with("x", "y", lambda a, b: a - b).alias("z")), "z", dim)
    values, axes = np.linalg.eigh(c)
    keep = values > ridge * max(values.max(), 1e-12)
    white = axes[:, keep] / np.sqrt(values[keep])
    gap, turn = np.linalg.eigh(white.T @ (g / max(n, 1)) @ white)
    return {"mean": mean, "W": (white @ turn)[:, :out], "disagreement": gap[:out]}


def spectral_encode(df: DataFrame, enc: dict, vec: str = "v", name: str = "h") -> DataFrame:
    return df.withColumn(name, project(vec, enc["W"], enc["mean"]))


def forward(x: np.ndarray, w: dict) -> np.ndarray:
    """Two layers of linear map, affine normalisation and ReLU."""
    h = np.maximum((x @ w["W1"] + w["b1"]) * w["s1"] + w["t1"], 0.0)
    return np.maximum((h @ w["W2"] + w["b2"]) * w["s2"] + w["t2"], 0.0)


def encode(df: DataFrame, weights: dict, subset: list[int] | None = None, vec: str = "v", name: str = "h") -> DataFrame:
    """Frozen encoder on the full row, or on the row with the features outside the subset set to 0."""
    w = {k: np.asarray(v, dtype=float) for k, v in weights.items()}
    keep = np.ones(len(w["W1"]), bool)
    if subset is not None:
        keep[:] = False
        keep[list(subset)] = True

    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(forward(stack(x) * keep, w))) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(name, apply(F.col(vec)))


class LatentSpace:
    """Search space of a frozen encoder: one encoder for all subsets, seen through the mask."""

    def __init__(self, weights: dict) -> None:
        self.weights = {k: np.asarray(v, dtype=float) for k, v in weights.items()}

    def rows(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return forward(x * mask, self.weights)

    def dims(self, mask: np.ndarray):
        return slice(None)

    def view(self, mask: np.ndarray):
        return mask.tobytes()


def collapse_check(df: DataFrame, dim: int, vec: str = "h", floor: float = 0.01) -> DataFrame:
    """Mean deviation over the dimensions and the number of collapsed ones."""
    row = df.agg(*[F.stddev_samp(F.col(vec)[i]).alias(f"s{i}") for i in range(dim)])
    sds = [F.col(f"s{i}") for i in range(dim)]
    return row.select(
        (total(sds) / dim).alias("mean_std"), F.size(F.filter(F.array(*sds), lambda s: s < floor)).cast("bigint").alias("n_collapsed")
    )


def pca_95(df: DataFrame, features: list[str], share: float = 0.95) -> tuple[DataFrame, int, list[float]]:
    """Principal components that explain the given share: scores, their number, the explained shares."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    rows = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=len(features), inputCol="_c", outputCol="_p").fit(rows)
    explained = [float(v) for v in model.explainedVariance.toArray()]
    n = next((i + 1 for i in range(len(explained)) if math.fsum(explained[: i + 1]) > share), len(explained))
    from pyspark.ml.functions import vector_to_array

    scores = model.transform(rows).withColumn("pc", F.slice(vector_to_array("_p"), 1, n)).drop("_x", "_c", "_p")
    return scores, n, explained
