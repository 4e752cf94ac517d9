"""Scans, the dataset registry and table sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telesift.operators.profile import signed_log_features
from telesift.table import FeatureTable, numeric_columns


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Parquet scan; ``spread`` deals a file with fewer splits than cores over all of them.

    Large tables have many splits and are read as they are, without a shuffle. Column pruning
    and filters still reach the scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sampling: float = 1.0, mode: str = "PERMISSIVE") -> DataFrame:
    """Wide CSV with a header; types are inferred unless a schema is given. ``mode`` is Spark's for malformed cells."""
    reader = spark.read.option("header", True).option("mode", mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling).csv(path)


def scan_pruned(spark: SparkSession, path: str, deny: list[str], meta: list[str], sampling: float = 0.1) -> DataFrame:
    """Infer types from a sample, then read only the numeric features and the listed meta columns.

    Features are read as doubles; text that the sample did not foresee in one of them ends the read with an error.
    """
    sniffed = scan_csv(spark, path, sampling=sampling)
    features = numeric_columns(sniffed, [*deny, *meta])
    wide = StructType.fromJson(sniffed.schema.jsonValue())
    fields = ", ".join(f"`{f.name}` {'double' if f.name in features else 'string'}" for f in wide.fields)
    return scan_csv(spark, path, schema=fields, mode="FAILFAST").select(*meta, *features)


def materialize(ft: FeatureTable, path: str) -> FeatureTable:
    """Write the typed table and its feature list once; later stages read the parquet files."""
    ft.to_double().df.write.mode("overwrite").parquet(f"{path}/rows")
    ft.features_df().coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    return load(ft.df.sparkSession, path, ft)


def load(spark: SparkSession, path: str, like: FeatureTable) -> FeatureTable:
    feats = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("pos").collect()]
    return FeatureTable(
        spark.read.parquet(f"{path}/rows"), feats, like.id_col, like.groups, like.tasks, like.strat_col, like.name
    )


class DatasetRegistry:
    """Datasets by name; a derived variant is a function of another dataset."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable[[SparkSession, str], FeatureTable]] = {}

    def add(self, name: str, builder: Callable[[SparkSession, str], FeatureTable]) -> None:
        self._builders[name] = builder

    def add_log_variant(self, name: str, base: str) -> None:
        def build(spark: SparkSession, root: str) -> FeatureTable:
            ft = self.load(base, spark, root)
            return FeatureTable(
                signed_log_features(ft.df, ft.features), ft.features, ft.id_col, ft.groups, ft.tasks, ft.strat_col, name
            )

        self._builders[name] = build

    def load(self, name: str, spark: SparkSession, root: str) -> FeatureTable:
        if name not in self._builders:
            raise ValueError(f"unknown dataset {name}; known: {sorted(self._builders)}")
        return self._builders[name](spark, root)


def groups_from_prefix(features: DataFrame, sep: str = "_") -> DataFrame:
    """Feature groups named by the part of the feature name before the separator."""
    return features.groupBy(F.substring_index("feature", sep, 1).alias("group")).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "feature"))), lambda s: s["feature"]), ",").alias("members"),
    )


def resolve_names(sets: DataFrame, features: DataFrame) -> DataFrame:
    """Stored feature names -> positions; unknown names drop out."""
    names = sets.withColumn("feature", F.explode("names")).drop("names")
    return names.join(F.broadcast(features.select("pos", "feature")), "feature")


def union_results(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Concatenate CSV result tables; columns missing in one file become NULL."""
    out = None
    for p in paths:
        part = scan_csv(spark, p, schema)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> str:
    """Table sink; the job's output appears only when the commit succeeds."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return path
