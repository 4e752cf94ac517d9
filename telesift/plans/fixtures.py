"""Input tables of the registered queries, derived from the given parquet tables.

Every fixture exists twice: as a DataFrame and as the SQL text of a CTE, so that a query
and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.sources.tables import read_table
from telesift.table import FeatureTable

FEATURES = [
    "vol_qty", "vol_line", "price_ext", "price_order", "price_unit", "price_retail",
    "rate_discount", "rate_tax", "vol_size", "edge_missing", "edge_inf", "edge_const",
]
GROUPS = {
    "Volume": ["vol_qty", "vol_line", "vol_size"],
    "Price": ["price_ext", "price_order", "price_unit", "price_retail"],
    "Rate": ["rate_discount", "rate_tax"],
    "Edge": ["edge_missing", "edge_inf", "edge_const"],
}
DENY = ["label1", "label2", "label_full", "device_name", "ts"]
REFERENCE_SET = ["vol_qty", "price_ext", "rate_discount", "rate_tax", "not_in_table"]
DIM = 64

FLOWS = """flows AS (
SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
              CAST(l_suppkey AS VARCHAR), CAST(CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT) AS VARCHAR))) AS row_id,
       l_quantity AS vol_qty, CAST(l_linenumber AS DOUBLE) AS vol_line, l_extendedprice AS price_ext,
       o_totalprice AS price_order, l_extendedprice / l_quantity AS price_unit, p_retailprice AS price_retail,
       l_discount AS rate_discount, l_tax AS rate_tax, CAST(p_size AS DOUBLE) AS vol_size,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 2 END AS edge_missing,
       CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_discount END AS edge_inf,
       CAST(0 AS DOUBLE) AS edge_const,
       CASE WHEN l_returnflag = 'R' THEN 'attack' ELSE 'benign' END AS label1,
       concat(l_returnflag, l_linestatus) AS label2,
       concat('exec_', l_returnflag, '_', CAST(l_partkey % 40 AS VARCHAR)) AS label_full,
       concat('dev_', CAST(l_suppkey % 38 AS VARCHAR)) AS device_name,
       l_shipdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def read(spark: SparkSession, sf: str, table: str, spread: bool = False) -> DataFrame:
    return read_table(spark, f"{sf}/{table}.parquet", spread)


def flows(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    """Wide flow records: twelve features in four groups, with missing, infinite and constant columns.

    ``spread`` serves queries with much work per row on a file that is a single split.
    """
    line, orders, part = read(spark, sf, "lineitem", spread), read(spark, sf, "orders"), read(spark, sf, "part")
    wide = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    key = F.md5(
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint"),
        )
    )
    d = lambda c: F.col(c).cast("double")
    return wide.select(
        key.alias("row_id"),
        F.col("l_quantity").alias("vol_qty"),
        d("l_linenumber").alias("vol_line"),
        F.col("l_extendedprice").alias("price_ext"),
        F.col("o_totalprice").alias("price_order"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_unit"),
        F.col("p_retailprice").alias("price_retail"),
        F.col("l_discount").alias("rate_discount"),
        F.col("l_tax").alias("rate_tax"),
        d("p_size").alias("vol_size"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 2).alias("edge_missing"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("edge_inf"),
        F.lit(0.0).alias("edge_const"),
        F.when(F.col("l_returnflag") == "R", "attack").otherwise("benign").alias("label1"),
        F.concat("l_returnflag", "l_linestatus").alias("label2"),
        F.concat(F.lit("exec_"), "l_returnflag", F.lit("_"), F.col("l_partkey") % 40).alias("label_full"),
        F.concat(F.lit("dev_"), F.col("l_suppkey") % 38).alias("device_name"),
        F.col("l_shipdate").alias("ts"),
    )


def flow_table(spark: SparkSession, sf: str) -> FeatureTable:
    return FeatureTable(
        flows(spark, sf), list(FEATURES), "row_id", GROUPS, {"binary": "label1", "multiclass": "label2"}, "label2", "flows"
    )


WINDOW_FEATURES = ["n_all", "n_view", "n_click", "n_error", "value_avg", "value_min", "value_max", "value_std"]

WINDOWS = """windows AS (
SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS n_all,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS n_view,
       CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS n_click,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error,
       avg(value) AS value_avg, min(value) AS value_min, max(value) AS value_max,
       coalesce(stddev_pop(value), 0) AS value_std,
       CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'attack' ELSE 'benign' END AS label1
FROM events GROUP BY user_id, date_trunc('day', ts))"""


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Per-user daily windows of the event stream."""
    ev = read(spark, sf, "events")
    n = lambda t: F.sum((F.col("event_type") == t).cast("long"))
    return ev.groupBy("user_id", F.date_trunc("day", F.col("ts")).alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_all"),
        n("view").alias("n_view"),
        n("click").alias("n_click"),
        n("error").alias("n_error"),
        F.avg("value").alias("value_avg"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("value_std"),
        F.when(F.max((F.col("event_type") == "error").cast("int")) == 1, "attack").otherwise("benign").alias("label1"),
    )


EMB = """emb AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"""


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("bigint").alias("label"),
    )


EMB_WIDE_FEATURES = [f"e{i}" for i in range(DIM)]


def emb_wide(spark: SparkSession, sf: str, dims: int = DIM) -> DataFrame:
    return emb(spark, sf).select("row_id", "label", *[F.col("v")[i].alias(f"e{i}") for i in range(dims)])


LABELINGS = """labelings AS (
SELECT 'p0' AS pipeline, 42 AS seed, vec_id AS row_id, CAST(label AS BIGINT) AS lab FROM embeddings
UNION ALL SELECT 'p1', 42, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) FROM embeddings
UNION ALL SELECT 'p2', 43, vec_id, vec_id % 4 FROM embeddings
UNION ALL SELECT 'p3', 43, vec_id, CAST(9 - label AS BIGINT) FROM embeddings)"""


def labelings(spark: SparkSession, sf: str) -> DataFrame:
    """Four pipelines that label the same rows."""
    e = read(spark, sf, "embeddings")
    lab = F.col("label").cast("bigint")
    p = lambda name, seed, c: F.struct(
        F.lit(name).alias("pipeline"), F.lit(seed).alias("seed"), F.col("vec_id").alias("row_id"), c.cast("bigint").alias("lab")
    )
    return e.select(
        F.inline(
            F.array(
                p("p0", 42, lab),
                p("p1", 42, F.when(F.col("vec_id") % 7 == 0, (lab + 1) % 10).otherwise(lab)),
                p("p2", 43, F.col("vec_id") % 4),
                p("p3", 43, 9 - lab),
            )
        )
    )


PREDICTIONS = """predictions AS (
SELECT l_linenumber AS fold, concat(l_returnflag, l_linestatus) AS y,
       CASE WHEN l_partkey % 9 = 0 THEN 'NO' WHEN l_partkey % 11 = 0 THEN 'ZZ'
            ELSE concat(l_returnflag, l_linestatus) END AS p
FROM lineitem WHERE NOT (l_linenumber = 3 AND l_returnflag = 'R'))"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """True and predicted class; two classes are absent from fold 3 and one is only ever predicted."""
    line = read(spark, sf, "lineitem").filter(~((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "R")))
    y = F.concat("l_returnflag", "l_linestatus")
    return line.select(
        F.col("l_linenumber").alias("fold"),
        y.alias("y"),
        F.when(F.col("l_partkey") % 9 == 0, "NO").when(F.col("l_partkey") % 11 == 0, "ZZ").otherwise(y).alias("p"),
    )


# --- result tables of many runs: every score is derived from an aggregate of lineitem per run

VARIANTS = [  # dataset, protocol, variant, vi, one seed and few folds only
    ("flows", "sample_k10", "main", 0, False),
    ("flows", "group_exec_k5", "main", 1, True),
    ("flows", "sample_k10", "aug_independent", 2, True),
    ("flows", "sample_k10", "aug_none", 3, True),
    ("windows", "sample_k10", "main", 4, False),
]
METHODS = [  # method, base number of features, mi
    ("proposed", 9, 0), ("all_features", 12, 1), ("mcfs_5", 5, 2), ("kmeans_sil", 7, 3), ("variance_5", 5, 4),
    ("laplacian_5", 5, 5), ("proposed_b3", 3, 6), ("proposed_b5", 5, 7), ("kmeans_sil_b3", 3, 8), ("kmeans_sil_b5", 5, 9),
    ("mcfs_3", 3, 10), ("variance_3", 3, 11), ("laplacian_3", 3, 12), ("kmeans_sil_at_nprop", 9, 13),
    ("proposed_backward_only", 8, 14),
]
TASKS = [("binary", 0), ("multiclass", 1)]
CLASSIFIERS = [("rf", 0), ("dt", 1), ("knn", 2)]

RUN_KEYS = """run_keys AS (
SELECT 42 + CAST(l_suppkey % 3 AS INTEGER) AS seed, CAST(l_partkey % 10 AS INTEGER) AS fold,
       CAST(sum(l_partkey + 7 * l_suppkey + 3 * l_linenumber) % 9973 AS BIGINT) AS h
FROM lineitem GROUP BY 1, 2)"""


def _values(rows) -> str:
    lit = lambda v: ("true" if v else "false") if isinstance(v, bool) else (f"'{v}'" if isinstance(v, str) else str(v))
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


EVAL_LONG = f"""{RUN_KEYS}, eval_raw AS (
SELECT v.dataset, v.protocol, r.seed, r.fold, v.variant, m.method,
       m.nf + CASE WHEN m.method = 'proposed' THEN CAST(r.h % 3 AS INTEGER)
                   WHEN m.method = 'kmeans_sil' THEN CAST(r.h % 4 AS INTEGER)
                   WHEN m.method = 'proposed_b5' AND r.h % 5 = 0 THEN -1 ELSE 0 END AS n_features,
       t.task, c.clf, r.h, m.mi, v.vi, (r.h * (m.mi + 2) + r.fold * 13 + t.ti * 3 + c.ci * 11 + v.vi * 7) % 17 AS q
FROM run_keys r
CROSS JOIN (VALUES {_values(VARIANTS)}) AS v(dataset, protocol, variant, vi, few)
CROSS JOIN (VALUES {_values(METHODS)}) AS m(method, nf, mi)
CROSS JOIN (VALUES {_values(TASKS)}) AS t(task, ti)
CROSS JOIN (VALUES {_values(CLASSIFIERS)}) AS c(clf, ci)
WHERE (NOT v.few OR (r.seed = 42 AND r.fold < 5))
  AND (m.method <> 'kmeans_sil_at_nprop' OR r.h % 3 <> 0)
  AND (m.method <> 'proposed_backward_only' OR r.h % 2 = 0)
  AND (v.variant = 'main' OR m.method LIKE 'proposed%')),
eval_long AS (
SELECT dataset, protocol, seed, fold, variant, method, n_features, task, clf,
       0.9e0 + q / 1000.0e0 - mi / 200.0e0 AS f1_macro, 0.92e0 + q / 2000.0e0 - mi / 250.0e0 AS accuracy,
       0.91e0 + q / 1500.0e0 - mi / 220.0e0 AS precision_macro, 0.89e0 + q / 1200.0e0 - mi / 210.0e0 AS recall_macro,
       0.8e0 + q / 900.0e0 - mi / 180.0e0 AS mcc
FROM eval_raw)"""


def run_keys(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem")
    return line.groupBy(
        (42 + F.col("l_suppkey") % 3).cast("int").alias("seed"), (F.col("l_partkey") % 10).cast("int").alias("fold")
    ).agg((F.sum(F.col("l_partkey") + 7 * F.col("l_suppkey") + 3 * F.col("l_linenumber")) % 9973).alias("h"))


def _options(rows, names) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]))


def eval_long(spark: SparkSession, sf: str) -> DataFrame:
    """Scores per dataset, protocol, seed, fold, variant, method, task and classifier."""
    runs = run_keys(spark, sf)
    d = (
        runs.withColumn("v", _options(VARIANTS, ["dataset", "protocol", "variant", "vi", "few"]))
        .filter("NOT v.few OR (seed = 42 AND fold < 5)")
        .withColumn("m", _options(METHODS, ["method", "nf", "mi"]))
        .filter("v.variant = 'main' OR m.method LIKE 'proposed%'")
        .filter("m.method <> 'kmeans_sil_at_nprop' OR h % 3 <> 0")
        .filter("m.method <> 'proposed_backward_only' OR h % 2 = 0")
        .withColumn("t", _options(TASKS, ["task", "ti"]))
        .withColumn("c", _options(CLASSIFIERS, ["clf", "ci"]))
    )
    q = (F.col("h") * (F.col("m.mi") + 2) + F.col("fold") * 13 + F.col("t.ti") * 3 + F.col("c.ci") * 11 + F.col("v.vi") * 7) % 17
    extra = (
        F.when(F.col("m.method") == "proposed", F.col("h") % 3)
        .when(F.col("m.method") == "kmeans_sil", F.col("h") % 4)
        .when((F.col("m.method") == "proposed_b5") & (F.col("h") % 5 == 0), -1)
        .otherwise(0)
        .cast("int")
    )
    d = d.withColumn("q", q)
    score = lambda base, a, b: F.lit(base) + F.col("q") / F.lit(a) - F.col("m.mi") / F.lit(b)
    return d.select(
        "v.dataset", "v.protocol", "seed", "fold", "v.variant", "m.method", (F.col("m.nf") + extra).alias("n_features"),
        "t.task", "c.clf",
        score(0.9, 1000.0, 200.0).alias("f1_macro"),
        score(0.92, 2000.0, 250.0).alias("accuracy"),
        score(0.91, 1500.0, 220.0).alias("precision_macro"),
        score(0.89, 1200.0, 210.0).alias("recall_macro"),
        score(0.8, 900.0, 180.0).alias("mcc"),
    )


SELECTIONS = f"""{RUN_KEYS}, selections AS (
SELECT seed * 10 + fold AS run_id, seed, fold, pos, 2 + CAST(h % 5 AS INTEGER) AS k_star
FROM run_keys CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS pos) AS p
WHERE ((h % 1009) * (pos + 3) + pos * pos) % 11 < 8)"""


def selections(spark: SparkSession, sf: str) -> DataFrame:
    """Selected feature positions per run, with the run's chosen number of clusters."""
    d = run_keys(spark, sf).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(11))))
    d = d.filter(((F.col("h") % 1009) * (F.col("pos") + 3) + F.col("pos") * F.col("pos")) % 11 < 8)
    return d.select(
        (F.col("seed") * 10 + F.col("fold")).alias("run_id"), "seed", "fold", "pos", (2 + F.col("h") % 5).cast("int").alias("k_star")
    )


HISTORY = f"""{RUN_KEYS}, history AS (
SELECT seed * 10 + fold AS run_id, s AS step,
       CASE WHEN s = 0 THEN 'init' WHEN s <= 6 THEN 'remove' ELSE 'add' END AS action,
       CASE WHEN s = 0 THEN NULL WHEN s <= 6 THEN CAST((h + 5 * s) % 12 AS INTEGER)
            ELSE CAST((h + 5 * (s - 5)) % 12 AS INTEGER) END AS pos,
       CASE WHEN s <= 6 THEN 12 - s ELSE s END AS n,
       0.3e0 + s * 0.01e0 + (h % 7) / 1000.0e0 AS j
FROM run_keys CROSS JOIN (SELECT CAST(unnest(range(9)) AS INTEGER) AS s) AS steps)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Search log per run: six removals, then two of the removed features come back."""
    d = run_keys(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(8))))
    s = F.col("step")
    pos = F.when(s == 0, None).when(s <= 6, (F.col("h") + 5 * s) % 12).otherwise((F.col("h") + 5 * (s - 5)) % 12)
    return d.select(
        (F.col("seed") * 10 + F.col("fold")).alias("run_id"),
        "step",
        F.when(s == 0, "init").when(s <= 6, "remove").otherwise("add").alias("action"),
        pos.cast("int").alias("pos"),
        F.when(s <= 6, 12 - s).otherwise(s).alias("n"),
        (F.lit(0.3) + s * F.lit(0.01) + (F.col("h") % 7) / F.lit(1000.0)).alias("j"),
    )


PHI = """phi AS (
SELECT e.vec_id AS row_id, CAST(e.label AS BIGINT) AS row_cluster, k.c AS cluster, ft.pos AS pos,
       ((e.vec_id * 31 + k.c * 17 + ft.pos * 7 + (ft.pos * ft.pos * k.c) % 13) % 101 - 50) / 1000.0e0 AS phi
FROM embeddings e
CROSS JOIN (SELECT CAST(unnest(range(10)) AS BIGINT) AS c) AS k
CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS pos) AS ft)"""


def phi(spark: SparkSession, sf: str) -> DataFrame:
    """Signed attributions per row, cluster and feature position."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("bigint").alias("row_cluster"))
    e = e.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>")))
    e = e.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(11))))
    c, p = F.col("cluster"), F.col("pos")
    return e.withColumn("phi", ((F.col("row_id") * 31 + c * 17 + p * 7 + (p * p * c) % 13) % 101 - 50) / F.lit(1000.0))


FEATURE_DIM = "feature_dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{f}', '{next(g for g, m in GROUPS.items() if f in m)}')" for i, f in enumerate(FEATURES)
) + ") AS t(pos, feature, grp))"


def feature_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, f, next(g for g, m in GROUPS.items() if f in m)) for i, f in enumerate(FEATURES)]
    return spark.createDataFrame(rows, "pos int, feature string, grp string")


