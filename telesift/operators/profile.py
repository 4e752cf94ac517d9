"""Profiling, projections and filters over wide feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from telesift.functions.exprs import INF, feature_stats, null_safe_join, signed_log
from telesift.session import stage
from telesift.table import FeatureTable, numeric_columns


def present(c: str) -> Column:
    """The value, NULL where it is NaN."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def select_features(df: DataFrame, deny: list[str], keep: list[str] = ()) -> DataFrame:
    """Numeric columns that are not deny-listed, plus the named key columns."""
    return df.select(*keep, *[c for c in numeric_columns(df, [*deny, *keep])])


def _filled_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return feature_stats(df, cols, {"n_values": lambda c: F.count(F.col(c))}).select(
        F.col("feature").alias("column"), "n_values"
    )


def column_presence(df: DataFrame, expected: list[str]) -> DataFrame:
    """Expected columns, whether they exist, and how many values they hold."""
    want = df.sparkSession.createDataFrame([(c,) for c in expected], "column string")
    have = _filled_counts(df, [c for c in df.columns if c in expected])
    return want.join(F.broadcast(have), "column", "left").select(
        "column", F.col("n_values").isNotNull().alias("found"), F.coalesce("n_values", F.lit(0)).alias("n_values")
    )


def type_census(df: DataFrame, deny: list[str] = ()) -> DataFrame:
    """Number of string, numeric and usable columns (usable: numeric, allowed, not empty)."""
    numeric = numeric_columns(df)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    counts = _filled_counts(df, df.columns)
    kind = F.when(F.col("column").isin(numeric), "numeric").when(F.col("column").isin(strings), "string").otherwise("other")
    usable = F.col("column").isin([c for c in numeric if c not in deny]) & (F.col("n_values") > 0)
    return counts.withColumn("kind", kind).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum(usable.cast("int")).alias("n_usable")
    )


def label_distribution(df: DataFrame, cols: list[str], top: int = 10) -> DataFrame:
    """Count and percentage of the most frequent values of each label, with the class count."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in cols])))
    counts = long.filter(F.col("value").isNotNull()).groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("n_classes"))
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "value"))
    ).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "label").select(
        "label", "value", "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"), "rank", "n_classes"
    )


def distinct_entities(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.countDistinct(col).alias("n_entities"))


def quality_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and infinite values per column, worst columns ranked first."""
    x = lambda f: F.col(f).cast("double")
    stats = feature_stats(
        df,
        features,
        {
            "n_missing": lambda f: F.sum((F.col(f).isNull() | F.isnan(x(f))).cast("long")),
            "n_infinite": lambda f: F.sum(F.coalesce(F.abs(x(f)) == INF, F.lit(False)).cast("long")),
        },
    )
    worst = Window.orderBy(F.desc(F.col("n_missing") + F.col("n_infinite")), "pos")
    total = Window.partitionBy()
    return stats.select(
        "feature",
        "n_missing",
        "n_infinite",
        F.sum("n_missing").over(total).alias("total_missing"),
        F.sum("n_infinite").over(total).alias("total_infinite"),
        F.row_number().over(worst).alias("rank"),
    )


#: Statistics that tell constant columns.
CONSTANCY = {"sd": lambda f: F.stddev_samp(present(f)), "constant": lambda f: F.min(present(f))}


def zero_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """Features whose sample deviation is 0, with the constant they hold."""
    stats = feature_stats(df, features, CONSTANCY)
    return stats.filter("sd = 0").select("pos", "feature", "constant")


def group_mapping(ft: FeatureTable) -> DataFrame:
    """Per group: declared features, those found in the table, and the unmapped table columns."""
    spark = ft.df.sparkSession
    declared = spark.createDataFrame(
        [(g, f) for g, fs in ft.groups.items() for f in fs], "`group` string, feature string"
    )
    have = _filled_counts(ft.df, ft.features).withColumnRenamed("column", "feature")
    joined = declared.join(have, "feature", "full")
    return joined.groupBy(F.coalesce("group", F.lit("(unmapped)")).alias("group")).agg(
        F.count(F.lit(1)).alias("n_declared"),
        F.sum(F.col("n_values").isNotNull().cast("long")).alias("n_found"),
        F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_values"),
    )


def group_index(ft: FeatureTable) -> DataFrame:
    """(pos, feature, group_id) with every feature in exactly one group; raises otherwise."""
    owner: dict[str, int] = {}
    for gi, (g, members) in enumerate(ft.groups.items()):
        twice = [f for f in members if f in owner]
        if twice:
            raise ValueError(f"features in two groups: {twice}")
        owner.update({f: gi for f in members})
    missing = [f for f in ft.features if f not in owner]
    if missing:
        raise ValueError(f"features without group: {missing}")
    have = _filled_counts(ft.df, ft.features).withColumnRenamed("column", "feature")
    index = ft.df.sparkSession.createDataFrame(
        [(i, f, owner[f]) for i, f in enumerate(ft.features)], "pos int, feature string, group_id int"
    )
    return index.join(F.broadcast(have), "feature").select("pos", "feature", "group_id", "n_values")


def dataset_summary(df: DataFrame, features: list[str], label: str, entity: str) -> DataFrame:
    """One row: size, class and entity counts, missing and infinite cells, constant features.

    Rows are reduced per (label, entity) first, so the distinct counts run over few cells.
    """
    x = lambda f: F.col(f).cast("double")
    add = lambda cols: sum(cols[1:], cols[0])
    cells = df.groupBy(F.col(label).alias("_l"), F.col(entity).alias("_e")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(add([(F.col(f).isNull() | F.isnan(x(f))).cast("long") for f in features])).alias("missing"),
        F.sum(add([F.coalesce(F.abs(x(f)) == INF, F.lit(False)).cast("long") for f in features])).alias("infinite"),
        *[F.min(present(f)).alias(f"lo{i}") for i, f in enumerate(features)],
        *[F.max(present(f)).alias(f"hi{i}") for i, f in enumerate(features)],
    )
    same = lambda i: (F.min(f"lo{i}") == F.max(f"hi{i}")) & (F.abs(F.max(f"hi{i}")) < INF)
    return cells.agg(
        F.sum("n").alias("n_rows"),
        F.lit(len(features)).alias("n_features"),
        F.countDistinct("_l").alias("n_classes"),
        F.countDistinct("_e").alias("n_entities"),
        F.sum("missing").alias("n_missing"),
        F.sum("infinite").alias("n_infinite"),
        add([F.coalesce(same(i), F.lit(True)).cast("long") for i in range(len(features))]).alias("n_constant"),
    )


def idle_condition(features: list[str]) -> Column:
    return F.forall(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]), lambda x: x == 0)


def idle_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows in which every feature is zero."""
    return df.filter(idle_condition(features))


def signed_log_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*[signed_log(c).alias(c) if c in features else F.col(c) for c in df.columns])


def mask_features(df: DataFrame, features: list[str], keep: list[int]) -> DataFrame:
    """Features outside the subset become 0, the training mean after scaling."""
    zeroed = {f for i, f in enumerate(features) if i not in set(keep)}
    return df.select(*[F.lit(0.0).alias(c) if c in zeroed else F.col(c) for c in df.columns])


def derive_labels(df: DataFrame, flag: Column, positive: str = "attack", negative: str = "normal", name: str = "label1") -> DataFrame:
    return df.withColumn(name, F.when(flag, positive).otherwise(negative))


def short_name(c: Column, prefix: str = "network_") -> Column:
    return F.replace(F.replace(c, F.lit(prefix), F.lit("")), F.lit("_std_deviation"), F.lit("_std"))


def base_method(c: Column) -> Column:
    """Method name without its budget suffix (_25, _k10)."""
    return F.regexp_replace(c, r"_k?\d+$", "")


def encode_labels(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Lexicographic class index. The class list is reduced first and joined back."""
    classes = df.select(col).distinct()
    index = classes.withColumn(name or f"{col}_idx", F.row_number().over(Window.orderBy(col)) - 1)
    return null_safe_join(df, stage(index, "classes"), [col])
