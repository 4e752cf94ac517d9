"""Fit and apply of the cleaning and standardisation step, per table or per training fold.

Missing cells become 0 and infinite cells become the column's largest finite value. Both
rules are folded into mergeable moments (count, mean, squared deviations of the finite
cells, count of the infinite ones), so one scan yields the statistics of every fold and
of every "all folds but one" training part without expanding the rows k times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.functions.exprs import feature_stats, filled, finite_or_null, null_safe_join
from telesift.operators.profile import CONSTANCY, select_features
from telesift.session import stage


def _moments(df: DataFrame, features: list[str], by: list[str], further: dict | None = None) -> DataFrame:
    """Moments per feature and group; ``further`` statistics are taken by the same scan."""
    clean = lambda f: finite_or_null(filled(f))
    return feature_stats(
        df,
        features,
        {
            "n": lambda f: F.count(F.lit(1)),
            "nf": lambda f: F.count(clean(f)),
            "mu": lambda f: F.coalesce(F.avg(clean(f)), F.lit(0.0)),
            "vp": lambda f: F.coalesce(F.var_pop(clean(f)), F.lit(0.0)),
            "lo": lambda f: F.min(clean(f)),
            "hi": lambda f: F.max(clean(f)),
            **(further or {}),
        },
        by,
    ).withColumn("ss", F.col("vp") * F.col("nf")).drop("vp")


def _finish(m: DataFrame, by: list[str]) -> DataFrame:
    """Moments of the finite cells + infinite cells placed at the finite maximum."""
    fmax = F.coalesce("hi", F.lit(0.0))
    bad = F.col("n") - F.col("nf")
    mean = (F.col("nf") * F.col("mu") + bad * fmax) / F.col("n")
    ss = F.col("ss") + F.pow(F.col("mu") - fmax, 2) * F.col("nf") * bad / F.col("n")
    sd = F.sqrt(ss / F.col("n"))
    return m.select(
        *by,
        "pos",
        "feature",
        fmax.alias("fmax"),
        mean.alias("mean"),
        F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("std"),
        sd.alias("raw_std"),
        F.coalesce("lo", F.lit(0.0)).alias("raw_min"),
        fmax.alias("raw_max"),
    )


def fit_scaler(df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """Per feature (and group): fill value, mean, population deviation (0 -> 1), raw range."""
    return _finish(_moments(df, features, list(by)), list(by))


def fit_scaler_training(df: DataFrame, features: list[str], k: int, fold: str = "fold") -> DataFrame:
    """Statistics of each training part (all folds but one), merged from per-fold moments."""
    parts = _moments(df, features, [fold])
    parts = parts.withColumn("center", F.avg("mu").over(Window.partitionBy("pos")))
    spread = parts.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(
        F.col("eval_fold") != F.col(fold)
    )
    shift = F.col("mu") - F.col("center")
    merged = spread.groupBy("eval_fold", "pos", "feature").agg(
        F.sum("n").alias("n"),
        F.sum("nf").alias("nf"),
        (F.sum(F.col("nf") * shift) / F.sum("nf")).alias("d"),
        F.first("center").alias("center"),
        F.sum(F.col("ss") + F.col("nf") * shift * shift).alias("q"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    merged = merged.withColumn("d", F.coalesce("d", F.lit(0.0)))
    merged = merged.withColumn("mu", F.col("center") + F.col("d")).withColumn(
        "ss", F.greatest(F.col("q") - F.col("nf") * F.col("d") * F.col("d"), F.lit(0.0))
    )
    return _finish(merged, ["eval_fold"])


def _scaled(c: str, s: dict[str, Column]) -> Column:
    x = filled(c)
    return (F.coalesce(finite_or_null(x), s["fmax"]) - s["mean"]) / s["std"]


def apply_scaler(df: DataFrame, stats: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """Clean and standardise.

    Without groups the statistics, one line per feature, become literals of the projection. With groups they are pivoted
    to one row per group and written out first: Spark then knows their real size and broadcasts them only below its own
    threshold.
    """
    by = list(by)
    facts = ("fmax", "mean", "std")
    if by:
        row = [F.max(F.when(F.col("pos") == i, F.struct(*facts))).alias(f"_s{i}") for i in range(len(features))]
        joined = df.join(stage(stats.groupBy(*by).agg(*row), "scaler"), by)
        pick = {f: {n: F.col(f"_s{i}")[n] for n in facts} for i, f in enumerate(features)}
    else:
        joined = df
        known = {r["pos"]: r for r in stats.select("pos", *facts).collect()}
        missing = dict.fromkeys(facts)
        pick = {f: {n: F.lit(known.get(i, missing)[n]).cast("double") for n in facts} for i, f in enumerate(features)}
    return joined.select(*[_scaled(c, pick[c]).alias(c) if c in pick else F.col(c) for c in df.columns])


def clean_and_scale(df: DataFrame, deny: list[str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Whole-table variant: zero-variance features leave first, then fill and standardise."""
    slim = select_features(df, deny, keep)
    features = [c for c in slim.columns if c not in keep]
    # one scan tells the constant features and fits the others; a line per feature comes back
    found = _moments(slim, features, [], CONSTANCY)
    lines = found.collect()
    gone = {r["feature"] for r in lines if r["sd"] == 0}
    kept = [f for f in features if f not in gone]
    stats = found.sparkSession.createDataFrame(lines, found.schema)
    fitted = _finish(stats.filter(F.col("feature").isin(kept)), []).withColumn("pos", F.array_position(F.array(*[F.lit(f) for f in kept]), F.col("feature")).cast("int") - 1)
    return apply_scaler(slim.select(*keep, *kept), fitted, kept), kept


def minmax_variance(stats: DataFrame) -> DataFrame:
    """Population variance after min-max scaling, from the fitted statistics alone."""
    span = F.when(F.col("raw_max") > F.col("raw_min"), F.col("raw_max") - F.col("raw_min")).otherwise(F.lit(1.0))
    by = [c for c in ("eval_fold", "fold") if c in stats.columns]
    return stats.select(*by, "pos", "feature", F.pow(F.col("raw_std") / span, 2).alias("var01"))
