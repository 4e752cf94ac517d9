"""Registered queries: classifiers, metrics, the forest proxy and explanation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.operators import clusters as Cl
from telesift.operators import evaluate as E
from telesift.operators import explain as X
from telesift.operators import sampling as M
from telesift.operators import scaling as S
from telesift.plans import fixtures as fx
from telesift.plans.base_queries import folded
from telesift.plans.cluster_queries import ASSIGNED, EMB_F, _centers
from telesift.plans.registry import query, r
from telesift.session import scratch_path, stage

FS = fx.FEATURES

# ---------------------------------------------------------------- metrics on given predictions

COUNTS = """cells AS (SELECT fold, y, p, count(*) AS n FROM predictions GROUP BY 1, 2, 3),
    cls AS (SELECT DISTINCT fold, c FROM (SELECT fold, y AS c FROM cells UNION ALL SELECT fold, p FROM cells)),
    cc AS (SELECT cls.fold, c, coalesce(sum(n) FILTER (WHERE y = c AND p = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE y = c), 0) AS t, coalesce(sum(n) FILTER (WHERE p = c), 0) AS q
      FROM cls JOIN cells USING (fold) GROUP BY 1, 2),
    sc AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0 END AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS re, 2 * tp / (t + q) AS f1 FROM cc)"""


def _conf(spark, sf):
    return E.confusion(fx.predictions(spark, sf), ["fold"])


@query("confusion", f"WITH {fx.PREDICTIONS}, {COUNTS} SELECT fold, y, p, n FROM cells")
def confusion(spark, sf):
    return _conf(spark, sf)


@query(
    "metrics",
    f"""WITH {fx.PREDICTIONS}, {COUNTS}, g AS (SELECT fold, avg(f1) AS f1, avg(pr) AS pr, avg(re) AS re, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS n,
      CAST(sum(t * q) AS DOUBLE) AS tq, CAST(sum(t * t) AS DOUBLE) AS tt, CAST(sum(q * q) AS DOUBLE) AS qq FROM sc GROUP BY 1)
    SELECT fold, {r('f1')} AS f1_macro, {r('c / n')} AS accuracy, {r('pr')} AS precision_macro, {r('re')} AS recall_macro, {r('(c * n - tq) / sqrt((n * n - qq) * (n * n - tt))')} AS mcc FROM g""",
)
def metrics(spark, sf):
    return E.metrics(_conf(spark, sf), ["fold"])


@query(
    "per_class_f1",
    f"""WITH {fx.PREDICTIONS}, {COUNTS}, every AS (SELECT f.fold, y.y AS c FROM (SELECT DISTINCT fold FROM predictions) f CROSS JOIN (SELECT DISTINCT y FROM predictions) y)
    SELECT fold, c AS cls, {r('coalesce(f1, 0.0)')} AS f1, CAST(coalesce(t, 0) AS BIGINT) AS support FROM every LEFT JOIN sc USING (fold, c)""",
)
def per_class_f1(spark, sf):
    return E.per_class_f1(_conf(spark, sf), ["fold"], E.fold_classes(fx.predictions(spark, sf)))


FID = f"""fid AS (SELECT fold, CAST(sum(t) AS BIGINT) AS n, sum(tp) / sum(t) AS accuracy, avg(re) AS balanced_accuracy, avg(f1) AS macro_f1, count(*) AS n_classes FROM sc WHERE t > 0 GROUP BY 1)"""
FID_COLS = f"n, {r('accuracy')} AS accuracy, {r('balanced_accuracy')} AS balanced_accuracy, {r('macro_f1')} AS macro_f1, n_classes"


@query("fidelity", f"WITH {fx.PREDICTIONS}, {COUNTS}, {FID} SELECT fold, {FID_COLS} FROM fid")
def fidelity(spark, sf):
    return E.fidelity(_conf(spark, sf), ["fold"])


SPLITS = "CASE WHEN l_linenumber <= 2 THEN 'in_sample' WHEN l_linenumber <= 4 THEN 'heldout' ELSE 'test_fold' END"


@query(
    "proxy_fidelity",
    f"""WITH {fx.PREDICTIONS.replace('l_linenumber AS fold', SPLITS + ' AS fold')}, {COUNTS}, {FID} SELECT fold AS split, {FID_COLS} FROM fid""",
)
def proxy_fidelity(spark, sf):
    split = F.when(F.col("fold") <= 2, "in_sample").when(F.col("fold") <= 4, "heldout").otherwise("test_fold")
    return X.proxy_fidelity(fx.predictions(spark, sf).withColumn("split", split), ["split"])


# ---------------------------------------------------------------- classifiers


def _flow_splits(spark, sf, label: str, k: int = 5):
    """Training and test rows of scaled flows, every fold held out once."""
    folds = stage(M.stratified_folds(fx.flows(spark, sf), "label2", k).select("row_id", "fold", label, *FS), "folds")
    stats = stage(S.fit_scaler_training(folds, FS, k), "scalers")
    for f in range(k):
        rows = S.apply_scaler(folds, stats.filter(F.col("eval_fold") == f), FS)
        yield rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)


def _trees(spark, sf, clf: str, k: int = 5):
    """Confusion cells of one classifier on all features, every fold held out once; trees need no scaling."""
    folds = M.stratified_folds(fx.flows(spark, sf), "label2", k).select("row_id", "fold", "label2", *FS)
    return E.evaluate_confusion(stage(folds, "folds"), {"all_features": []}, {"multiclass": "label2"}, {clf: {}}, FS, k)


@query("clf_rf")
def clf_rf(spark, sf):
    """Forests of 100 trees grown to purity, five folds."""
    return E.metrics(_trees(spark, sf, "rf"), ["fold"])


@query("clf_dt")
def clf_dt(spark, sf):
    """Trees grown to purity, five folds."""
    return E.metrics(_trees(spark, sf, "dt"), ["fold"])


@query("clf_dt_margins", f"WITH {fx.FLOWS}, {folded(5)} SELECT fold, label2 AS y, count(*) AS n, true AS known FROM folded GROUP BY 1, 2")
def clf_dt_margins(spark, sf):
    """Every row of every fold is answered once, with a class that exists."""
    cells = _trees(spark, sf, "dt")
    names = F.array(*[F.lit(c) for c in ("AF", "AO", "NF", "NO", "RF", "RO")])
    return cells.groupBy("fold", "y").agg(F.sum("n").alias("n"), F.min(F.array_contains(names, F.col("p"))).alias("known"))


@query("clf_gbt")
def clf_gbt(spark, sf):
    """Boosted trees of 100 rounds and depth 6, five folds."""
    cells = [stage(E.confusion(E.predict(train, test, FS, "label1", "gbt"), ["fold"]), "cells") for train, test in _flow_splits(spark, sf, "label1")]
    return E.metrics(reduce(DataFrame.unionByName, cells), ["fold"])


KNN_CLF = f"""{fx.EMB}, f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) - 1) % 5 AS fold FROM emb),
    nb AS (SELECT a.row_id, a.label AS y, b.label AS l, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS rn FROM f a JOIN f b ON a.fold = 0 AND b.fold <> 0),
    vt AS (SELECT row_id, y, l, count(*) AS c FROM nb WHERE rn <= 5 GROUP BY 1, 2, 3)"""


@query("clf_knn", f"WITH {KNN_CLF} SELECT row_id, any_value(y) AS label, arg_min(l, (-c, l)) AS p_label FROM vt GROUP BY 1")
def clf_knn(spark, sf):
    rows = M.stratified_folds(fx.emb_wide(spark, sf), "label", 5)
    return E.clf_knn(rows.filter("fold <> 0"), rows.filter("fold = 0"), EMB_F, ["label"])


WINDOW_F = ["n_all", "n_view", "n_click", "n_error", "value_avg", "value_min", "value_max", "value_std"]
WINDOW_SETS = {"all_features": [], "values": ["n_all", "value_avg", "value_min", "value_max", "value_std"]}
WINDOW_CLF = {"rf": {}, "dt": {}, "knn": {}}
WINDOW_ROWS = f"""{fx.WINDOWS}, named AS (SELECT *, user_id || '|' || date_diff('day', DATE '1970-01-01', CAST(window_start AS DATE)) AS row_id,
      CASE WHEN n_view > n_click THEN 'view' WHEN n_view < n_click THEN 'click' ELSE 'even' END AS label2 FROM windows), {folded(10, src='named')}"""


def _window_folds(spark, sf):
    rows = fx.windows(spark, sf)
    kind = F.when(F.col("n_view") > F.col("n_click"), "view").when(F.col("n_view") < F.col("n_click"), "click").otherwise("even")
    rows = rows.select(F.concat_ws("|", "user_id", F.unix_date(F.to_date("window_start"))).alias("row_id"), "label1", kind.alias("label2"), F.lit("x").alias("one_class"), *WINDOW_F)
    return stage(M.stratified_folds(rows, "label2", 10), "folds")


WINDOW_TASKS = {"binary": "label1", "multiclass": "label2", "skipped": "one_class"}


@query("evaluate_sets")
def evaluate_sets(spark, sf):
    """Ten folds, two subsets, two tasks: forests of 100 trees and single trees grown to purity, and neighbours."""
    return E.evaluate_sets(_window_folds(spark, sf), WINDOW_SETS, WINDOW_TASKS, WINDOW_CLF, WINDOW_F, 10)


@query(
    "evaluate_sets_margins",
    f"""WITH {WINDOW_ROWS}, t AS (SELECT fold, 'binary' AS task, label1 AS y, count(*) AS n FROM folded GROUP BY 1, 3 UNION ALL SELECT fold, 'multiclass', label2, count(*) FROM folded GROUP BY 1, 3)
    SELECT fold, m.method, task, c.clf, CAST(m.n_features AS INTEGER) AS n_features, y, n FROM t, (VALUES ('all_features', 8), ('values', 5)) AS m(method, n_features), (VALUES ('rf'), ('dt'), ('knn')) AS c(clf)""",
)
def evaluate_sets_margins(spark, sf):
    """Every cell of the comparison answers each row of its fold once."""
    classifiers = {"rf": {"trees": 3}, "dt": {}, "knn": {}}
    cells = E.evaluate_confusion(_window_folds(spark, sf), WINDOW_SETS, WINDOW_TASKS, classifiers, WINDOW_F, 10)
    return cells.groupBy("fold", "method", "task", "clf", "n_features", "y").agg(F.sum("n").alias("n"))


def _chain(spark, sf):
    """Folds, evaluation and stored tree in one go; four of the ten runs are done by an earlier call."""
    rows, root = _window_folds(spark, sf), scratch_path(spark, "chain")
    keys = "dataset string, protocol string, seed int, fold int, variant string"
    plan = spark.createDataFrame([("windows", "sample_k10", 42, f, "main") for f in range(10)], keys)
    args = (WINDOW_SETS, {"binary": "label1", "multiclass": "label2"}, {"dt": {}}, WINDOW_F, 10)
    E.evaluate_runs(rows, root, plan.filter("fold % 3 = 1 OR fold = 0"), *args)
    return E.evaluate_runs(rows, root, plan, *args)


@query(
    "run_chain",
    f"""WITH {WINDOW_ROWS}, c AS (SELECT 'binary' AS task, count(DISTINCT label1) AS n FROM folded UNION ALL SELECT 'multiclass', count(DISTINCT label2) FROM folded)
    SELECT 'windows' AS dataset, 'sample_k10' AS protocol, 42 AS seed, CAST(f AS INTEGER) AS fold, 'main' AS variant, m.method, CAST(m.n_features AS INTEGER) AS n_features, task, 'dt' AS clf, CAST(n AS INTEGER) AS n_classes, true AS consistent
    FROM c, (SELECT unnest(range(10)) AS f), (VALUES ('all_features', 8), ('values', 5)) AS m(method, n_features)""",
)
def run_chain(spark, sf):
    """Every run of the plan is in the tree once, and its macro F1 is the mean of its stored class values."""
    mean = F.aggregate("per_class_f1", F.lit(0.0), lambda a, v: a + v) / F.size("per_class_f1")
    return _chain(spark, sf).select("dataset", "protocol", "seed", "fold", "variant", "method", "n_features", "task", "clf", F.size("per_class_f1").alias("n_classes"), (F.abs(mean - F.col("f1_macro")) < 1e-9).alias("consistent"))


@query("run_chain_classes")
def run_chain_classes(spark, sf):
    """Mean F1 per class from the tree that the chain stored."""
    cells = _chain(spark, sf).filter("task = 'multiclass'")
    return cells.groupBy("method").agg(*[F.avg(F.col("per_class_f1")[i]).alias(c) for i, c in enumerate(("click", "even", "view"))])


# ---------------------------------------------------------------- proxy and attributions


def _clustered(spark, sf):
    centers = _centers(spark, sf)
    rows = Cl.relabel_by_size(Cl.assign(fx.emb(spark, sf), centers))
    return rows.select("row_id", "cluster", *[F.col("v")[i].alias(f) for i, f in enumerate(EMB_F)]), len(centers)


def _proxy(spark, sf):
    rows, k = _clustered(spark, sf)
    split = stage(X.proxy_split(rows, k), "proxy-split")
    return X.fit_proxy(split.filter("role = 'train'"), EMB_F), split


@query("fit_proxy")
def fit_proxy(spark, sf):
    model, split = _proxy(spark, sf)
    return X.proxy_fidelity(X.proxy_predictions(model, split, EMB_F), ["role"])


#: Sizes of the proxy's split per relabelled cluster: rows, training rows, held-out rows that are explained.
SPLIT_SIZES = f"""{ASSIGNED}, sz AS (SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS INTEGER) AS cluster, count(*) AS n, count(*) OVER () AS k FROM asg GROUP BY cluster),
    sp AS (SELECT cluster, n, CAST(greatest(1, least(5000 // k, floor(n * 0.7e0))) AS BIGINT) AS n_train FROM sz)"""


@query(
    "fit_proxy_scores",
    f"""WITH {SPLIT_SIZES}, q AS (SELECT unnest(['train', 'holdout']) AS role, cluster, unnest([n_train, n - n_train]) AS support FROM sp)
    SELECT role, cluster, support, true AS in_range, true AS f1_fits FROM q WHERE support > 0""",
)
def fit_proxy_scores(spark, sf):
    """Precision, recall and F1 of the proxy per cluster lie in range and belong together; supports are those of the split."""
    s = _proxy_scores(spark, sf)
    p, q = F.col("precision"), F.col("recall")
    f1 = F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)
    return s.select("role", F.col("cls").alias("cluster"), "support", (p.between(0, 1) & q.between(0, 1)).alias("in_range"), (F.abs(f1 - F.col("f1")) < 1e-12).alias("f1_fits"))


def _proxy_scores(spark, sf):
    model, split = _proxy(spark, sf)
    return E.per_class_scores(E.confusion(X.proxy_predictions(model, split, EMB_F), ["role"]), ["role"])


@query("proxy_cluster_scores")
def proxy_cluster_scores(spark, sf):
    """In-sample and held-out precision, recall and F1 of the proxy per cluster."""
    return _proxy_scores(spark, sf)


def _attributed(spark, sf):
    model, split = _proxy(spark, sf)
    rows = X.explained(split).withColumnRenamed("cluster", "row_cluster")
    return model, split, rows, X.tree_shap(rows, model, EMB_F, keep=["row_cluster"])


@query("tree_shap")
def tree_shap(spark, sf):
    """Attributions of the proxy at full size: 200 trees of depth 10."""
    return _attributed(spark, sf)[3]


@query(
    "tree_shap_sums",
    f"""WITH {SPLIT_SIZES} SELECT cluster AS row_cluster, least(300, n - n_train) AS n_rows, least(300, n - n_train) * k AS n_exact, {fx.DIM} AS n_features
    FROM sp JOIN (SELECT count(*) AS k FROM sp) ON true WHERE n > n_train""",
)
def tree_shap_sums(spark, sf):
    """Base value and attributions of every row and class add up to the forest's probability."""
    from pyspark.ml.functions import vector_to_array

    model, _, rows, phi = _attributed(spark, sf)
    base = F.array(*[F.lit(v) for v in X.base_values(model)])
    prob = model.transform(E.assembled(rows, EMB_F)).select("row_id", vector_to_array("probability").alias("p"))
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v) + F.element_at(base, F.col("cluster").cast("int") + 1)
    exact = F.abs(total - F.element_at("p", F.col("cluster").cast("int") + 1)) < 1e-9
    return phi.join(prob, "row_id").groupBy("row_cluster").agg(
        F.countDistinct("row_id").alias("n_rows"), F.sum(exact.cast("bigint")).alias("n_exact"), F.max(F.size("phi")).alias("n_features"))


@query("tree_shap_clarity")
def tree_shap_clarity(spark, sf):
    """Clarity of the clusters from the proxy's own attributions and held-out F1."""
    model, split, _, phi = _attributed(spark, sf)
    profile = stage(X.cluster_profile(X.by_feature(phi)), "profile")
    held = E.per_class_f1(E.confusion(X.proxy_predictions(model, split.filter("role = 'holdout'"), EMB_F), []), [])
    f1 = held.select(F.col("cls").cast("bigint").alias("cluster"), "f1")
    features = spark.createDataFrame([(i, f, f"group{i // 16}") for i, f in enumerate(EMB_F)], "pos int, feature string, grp string")
    label = F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 4), 16, 10).cast("int")
    rows = split.select(F.col("cluster").cast("bigint").alias("cluster"), F.when(label % 3 == 0, "benign").otherwise("attack").alias("label1"), F.concat(F.lit("kind_"), label % 4).alias("label2"))
    return X.clarity(profile, features, f1, rows)


SELECTED = [0, 1, 3, 5, 8]


def _selected(spark):
    return fx.feature_dim(spark).filter(F.col("pos").isin(SELECTED)).select("pos")


SEL = f"chosen(pos) AS (VALUES {', '.join(f'({p})' for p in SELECTED)})"
PROF = """prof AS (SELECT cluster, pos, coalesce(avg(abs(phi)) FILTER (WHERE row_cluster = cluster), 0) AS value FROM phi GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY value DESC, pos) AS rn, value / sum(value) OVER (PARTITION BY cluster) AS share FROM prof)"""
IMP = "imp AS (SELECT cluster, pos, avg(abs(phi)) AS value FROM phi GROUP BY 1, 2), ri AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY value DESC, pos) AS rn FROM imp)"
GI = "gi AS (SELECT pos, avg(abs(phi)) AS value FROM phi GROUP BY 1), rg AS (SELECT *, CAST(row_number() OVER (ORDER BY value DESC, pos) AS INTEGER) AS rank FROM gi)"


@query("cluster_profile", f"WITH {fx.PHI}, {PROF} SELECT cluster, pos, {r('value')} AS value FROM prof")
def cluster_profile(spark, sf):
    return X.cluster_profile(fx.phi(spark, sf))


@query("cluster_importance", f"WITH {fx.PHI}, {IMP} SELECT cluster, pos, {r('value')} AS value FROM imp")
def cluster_importance(spark, sf):
    return X.cluster_importance(fx.phi(spark, sf))


@query("global_importance", f"WITH {fx.PHI}, {GI} SELECT pos, {r('value')} AS value, rank FROM rg")
def global_importance(spark, sf):
    return X.global_importance(fx.phi(spark, sf))


@query(
    "group_importance",
    f"""WITH {fx.PHI}, {fx.FEATURE_DIM}, {GI}, {SEL}, dim AS (SELECT * FROM feature_dim WHERE pos < 10)
    SELECT coalesce(grp, 'Unknown') AS grp, {r('coalesce(sum(value), 0)')} AS total, count(c.pos) AS n_selected, count(*) AS n_features
    FROM gi FULL JOIN dim USING (pos) LEFT JOIN chosen c USING (pos) GROUP BY 1""",
)
def group_importance(spark, sf):
    return X.group_importance(X.global_importance(fx.phi(spark, sf)), fx.feature_dim(spark).filter("pos < 10"), _selected(spark))


@query(
    "clarity",
    f"""WITH {fx.PHI}, {fx.FEATURE_DIM}, {PROF}, rows AS (SELECT CAST(label AS BIGINT) AS cluster, CASE WHEN vec_id % 3 = 0 THEN 'benign' ELSE 'attack' END AS label1, 'kind_' || (vec_id % 4) AS label2, vec_id FROM embeddings),
    f AS (SELECT cluster, count(*) FILTER (WHERE vec_id % 5 <> 0) / count(*) AS f1 FROM rows GROUP BY 1),
    sh AS (SELECT cluster, sum(CASE WHEN rn <= 3 THEN share ELSE 0 END) AS top3_share, exp(-sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END)) AS n_eff, max(CASE WHEN rn = 1 THEN share END) AS top1_share,
      max(CASE WHEN rn = 1 THEN feature END) AS top1, max(CASE WHEN rn = 2 THEN feature END) AS top2, max(CASE WHEN rn = 3 THEN feature END) AS top3 FROM rk JOIN feature_dim USING (pos) GROUP BY 1),
    gv AS (SELECT cluster, grp, count(*) AS c, min(rn) AS f FROM rk JOIN feature_dim USING (pos) WHERE rn <= 5 GROUP BY 1, 2),
    g AS (SELECT cluster, arg_min(grp, (-c, f)) AS dominant_group, max(c) AS dominant_group_top5 FROM gv GROUP BY 1),
    sz AS (SELECT cluster, count(*) AS n_rows, count(*) / (SELECT count(*) FROM rows) AS share, count(*) FILTER (WHERE label1 = 'benign') / count(*) AS benign_share FROM rows GROUP BY 1),
    lb AS (SELECT cluster, arg_min(label2, (-c, label2)) AS dominant_label, max(c) / sum(c) AS dominant_label_share FROM (SELECT cluster, label2, count(*) AS c FROM rows GROUP BY 1, 2) GROUP BY 1),
    al AS (SELECT *, f1 * top3_share AS ci FROM sh JOIN g USING (cluster) JOIN sz USING (cluster) JOIN lb USING (cluster) JOIN f USING (cluster))
    SELECT cluster, {r('top3_share')} AS top3_share, {r('n_eff')} AS n_eff, {r('top1_share')} AS top1_share, top1, top2, top3, dominant_group, dominant_group_top5, n_rows, {r('benign_share')} AS benign_share,
    dominant_label, {r('dominant_label_share')} AS dominant_label_share, {r('f1')} AS f1, {r('share')} AS share, {r('ci')} AS clarity_index,
    CAST(row_number() OVER (ORDER BY ci DESC, cluster) AS INTEGER) AS clarity_rank FROM al""",
)
def clarity(spark, sf):
    e = fx.read(spark, sf, "embeddings")
    rows = e.select(
        F.col("label").cast("bigint").alias("cluster"), F.when(F.col("vec_id") % 3 == 0, "benign").otherwise("attack").alias("label1"),
        F.concat(F.lit("kind_"), F.col("vec_id") % 4).alias("label2"), "vec_id",
    )
    f1 = rows.groupBy("cluster").agg((F.sum((F.col("vec_id") % 5 != 0).cast("long")) / F.count(F.lit(1))).alias("f1"))
    return X.clarity(X.cluster_profile(fx.phi(spark, sf)), fx.feature_dim(spark), f1, rows)


@query(
    "top_features",
    f"WITH {fx.PHI}, {IMP}, {SEL} SELECT cluster, CAST(rn AS INTEGER) AS rank, pos, {r('value')} AS value, pos IN (SELECT pos FROM chosen) AS selected FROM ri WHERE rn <= 5",
)
def top_features(spark, sf):
    return X.top_features(X.cluster_importance(fx.phi(spark, sf)), _selected(spark), 5)


@query(
    "top_overlap",
    f"""WITH {fx.PHI}, {GI}, {SEL} SELECT count(*) FILTER (WHERE pos IN (SELECT pos FROM chosen)) AS n_selected, count(*) FILTER (WHERE pos NOT IN (SELECT pos FROM chosen)) AS n_not_selected FROM rg WHERE rank <= 10""",
)
def top_overlap(spark, sf):
    return X.top_overlap(X.global_importance(fx.phi(spark, sf)), _selected(spark), 10)


@query(
    "dominant_groups",
    f"""WITH {fx.PHI}, {fx.FEATURE_DIM}, {IMP}, t AS (SELECT cluster, rn, feature, grp, min(rn) OVER (PARTITION BY cluster, grp) = rn AS lead FROM ri JOIN feature_dim USING (pos) WHERE rn <= 3)
    SELECT cluster, string_agg(grp, ',' ORDER BY rn) FILTER (WHERE lead) AS groups, string_agg(feature, ',' ORDER BY rn) AS features FROM t GROUP BY 1""",
)
def dominant_groups(spark, sf):
    return X.dominant_groups(X.cluster_importance(fx.phi(spark, sf)), fx.feature_dim(spark))


@query(
    "representative",
    f"""WITH {fx.PHI}, s AS (SELECT cluster, row_id, sum(CAST(round(abs(phi) * 1000) AS BIGINT)) AS t, sum(abs(phi)) AS total FROM phi WHERE row_cluster = cluster GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY t DESC, row_id) AS rn FROM s) SELECT cluster, row_id, {r('total')} AS total FROM k WHERE rn = 1""",
)
def representative(spark, sf):
    return X.representative(fx.phi(spark, sf).withColumn("phi", F.rint(F.col("phi") * 1000))).withColumn("total", F.col("total") / 1000)


@query(
    "profile_matrix",
    f"""WITH {fx.PHI}, {fx.FEATURE_DIM}, {PROF}, pk AS (SELECT pos, max(share) AS peak, {', '.join(f'max(CASE WHEN cluster = {c} THEN share END) AS c{c}' for c in range(10))} FROM rk GROUP BY 1),
    o AS (SELECT *, CAST(row_number() OVER (ORDER BY peak DESC, pos) AS INTEGER) AS rank FROM pk)
    SELECT rank, pos, feature, grp, {', '.join(f"{r(f'c{c}')} AS c{c}" for c in range(10))} FROM o JOIN feature_dim USING (pos) WHERE rank <= 8""",
)
def profile_matrix(spark, sf):
    return X.profile_matrix(X.cluster_profile(fx.phi(spark, sf)), fx.feature_dim(spark), list(range(10)), 8)
