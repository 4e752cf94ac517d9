"""Removed features, group coverage and consensus of the chosen subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def removed_features(selected: DataFrame, features: DataFrame, reference: list[str]) -> DataFrame:
    return features.join(F.broadcast(selected.select("pos").distinct()), "pos", "left_anti").select(
        "pos", "feature", "grp", F.col("feature").isin(reference).alias("in_reference")
    )


def group_coverage(sets: DataFrame, features: DataFrame, methods: list[str]) -> DataFrame:
    """Selected features per group and method beside the group size, with a TOTAL line."""
    hits = features.join(sets.filter(F.col("method").isin(methods)), "pos", "left")
    counts = hits.rollup("grp").agg(
        F.countDistinct("pos").alias("total"),
        *[F.count(F.when(F.col("method") == m, 1)).alias(m) for m in methods],
    )
    return counts.select(F.coalesce("grp", F.lit("TOTAL")).alias("grp"), "total", *methods)


def consensus(sets: DataFrame, features: DataFrame, voters: list[str], challengers: list[str]) -> DataFrame:
    """Votes of the voting methods per feature, with majority, unanimous and exclusive flags."""
    marks = sets.groupBy("pos").agg(
        F.countDistinct(F.when(F.col("method").isin(voters), F.col("method"))).alias("votes"),
        *[F.max((F.col("method") == c).cast("int")).alias(f"in_{c}") for c in challengers],
    )
    joined = features.join(F.broadcast(marks), "pos", "left")
    votes = F.coalesce("votes", F.lit(0))
    flag = lambda c: F.coalesce(F.col(f"in_{c}"), F.lit(0)) == 1
    return joined.select(
        "pos",
        "feature",
        votes.alias("votes"),
        (votes * 2 > len(voters)).alias("majority"),
        (votes == len(voters)).alias("unanimous"),
        *[flag(c).alias(f"in_{c}") for c in challengers],
        *[(flag(c) & (votes == 0)).alias(f"only_{c}") for c in challengers],
    )
