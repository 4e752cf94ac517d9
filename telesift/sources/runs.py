"""The run tree: one folder per (dataset, protocol, seed, fold, variant) with JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ["f1_macro", "accuracy", "precision_macro", "recall_macro", "mcc"]
_METRIC_TYPE = "struct<" + ",".join(f"{m}:double" for m in METRICS) + ",per_class_f1:array<double>>"
EVAL_TYPE = (
    "map<string,struct<n_features:int,features:array<int>,results:map<string,map<string," + _METRIC_TYPE + ">>>>"
)
RUN_KEYS = ["dataset", "protocol", "seed", "fold", "variant"]
# <root>/<dataset>/<protocol>/seed<S>/fold<r>/<variant>/<file>, plain or as key=value folders
_SEG = r"(?:[a-z]+=)?([^/]+)"
_PATH = rf"/{_SEG}/{_SEG}/seed=?(\d+)/fold=?(\d+)/{_SEG}/(?:file=)?"


def _tree(spark: SparkSession, root: str, file: str) -> DataFrame:
    raw = (
        spark.read.text(f"{root}/*/*/*/*/*/*{file}", wholetext=True, recursiveFileLookup=True)
        .withColumn("_p", F.input_file_name())
    )
    pattern = _PATH + file.replace(".", r"\.")
    part = lambda i: F.regexp_extract("_p", pattern, i)
    return raw.select(
        part(1).alias("dataset"),
        part(2).alias("protocol"),
        part(3).cast("int").alias("seed"),
        part(4).cast("int").alias("fold"),
        part(5).alias("variant"),
        F.col("value"),
    )


def scan_runs(
    spark: SparkSession, root: str, file: str, dataset: str | None = None, protocol: str | None = None,
    variant: str | None = None, require_done: bool = False,
) -> DataFrame:
    """Result files of the tree with their run keys; unfinished runs can be left out."""
    runs = _tree(spark, root, file)
    for name, wanted in (("dataset", dataset), ("protocol", protocol), ("variant", variant)):
        if wanted is not None:
            runs = runs.filter(F.col(name) == wanted)
    if require_done:
        runs = runs.join(_tree(spark, root, "DONE.json").select(*RUN_KEYS).distinct(), RUN_KEYS, "left_semi")
    return runs


def eval_cells(runs: DataFrame) -> DataFrame:
    """Nested result JSON -> one line per method, task and classifier, with the stored F1 of every class."""
    methods = runs.select(*RUN_KEYS, F.explode(F.from_json("value", EVAL_TYPE)).alias("method", "m"))
    tasks = methods.select(
        *RUN_KEYS, "method", F.col("m.n_features").alias("n_features"), F.explode("m.results").alias("task", "t")
    )
    clfs = tasks.select(*RUN_KEYS, "method", "n_features", "task", F.explode("t").alias("clf", "s"))
    return clfs.select(*RUN_KEYS, "method", "n_features", "task", "clf", *[F.col(f"s.{m}").alias(m) for m in [*METRICS, "per_class_f1"]])


def eval_long(runs: DataFrame) -> DataFrame:
    """The long metrics table of a run tree."""
    return eval_cells(runs).drop("per_class_f1")


def per_class_long(runs: DataFrame) -> DataFrame:
    """The stored F1 of every class: one line per method, task, classifier and class position; results without it have none."""
    return eval_cells(runs).select(*RUN_KEYS, "method", "n_features", "task", "clf", F.posexplode("per_class_f1").alias("cls", "f1"))


def _documents(ev: DataFrame) -> DataFrame:
    """One eval.json per run from a long result table."""
    scores = F.struct(*METRICS, *[c for c in ["per_class_f1"] if c in ev.columns])
    clfs = ev.groupBy(*RUN_KEYS, "method", "n_features", "task").agg(
        F.map_from_entries(F.collect_list(F.struct("clf", scores))).alias("t")
    )
    tasks = clfs.groupBy(*RUN_KEYS, "method", "n_features").agg(
        F.map_from_entries(F.collect_list(F.struct("task", "t"))).alias("results")
    )
    return tasks.groupBy(*RUN_KEYS).agg(
        F.to_json(
            F.map_from_entries(F.collect_list(F.struct("method", F.struct("n_features", "results"))))
        ).alias("value")
    )


def _write(files: DataFrame, root: str) -> None:
    """Files of the runs they name take the place of earlier ones; other runs stay as they are."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEYS, "file").text(root)


def write_runs(ev: DataFrame, root: str, done: DataFrame) -> str:
    """Store a long result table as a run tree, one eval.json per run and a DONE.json per finished run.

    Marks are committed after the results, so a run that is marked is whole; one that was cut off is written again.
    """
    _write(_documents(ev).withColumn("file", F.lit("eval.json")), root)
    _write(done.select(*RUN_KEYS, F.to_json(F.struct("seed", "fold")).alias("value"), F.lit("DONE.json").alias("file")), root)
    return root


def unfinished(plan: DataFrame, root: str) -> DataFrame:
    """The runs of a plan (its run keys) that the tree does not mark as done."""
    spark = plan.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/*/*/*/file=DONE.json"))
    if not marks:
        return plan
    return plan.join(_tree(spark, root, "DONE.json").select(*RUN_KEYS).distinct(), RUN_KEYS, "left_anti")
