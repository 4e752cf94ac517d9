"""Registered queries: comparison tables over the long result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from telesift.operators import evaluate as E
from telesift.operators import reports as Rp
from telesift.operators import stability as St
from telesift.operators.coverage import removed_features
from telesift.plans import fixtures as fx
from telesift.plans.registry import query, r
from telesift.plans.stat_queries import FREQ, REC_SQL, compare_sql, jaccard_sql, nogueira_sql, paired_sql

D = len(fx.FEATURES)
TASKS, CLFS = ("binary", "multiclass"), ("rf", "dt", "knn")


def quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


METHODS = ["proposed", "kmeans_sil", "mcfs_5", "variance_5", "laplacian_5", "all_features"]
MAIN = "dataset = 'flows' AND protocol = 'sample_k10' AND variant = 'main'"
fold_avg = lambda c: f"avg({c})"


def rr(pairs) -> str:
    return ", ".join(f"{r(e)} AS {n}" for n, e in pairs)


_POINT_FOLD = f"""d AS (SELECT * FROM eval_long WHERE {MAIN} AND seed = 42 AND method IN ({quoted(METHODS)})),
    pf AS (SELECT method, task, fold, avg(f1_macro) AS f1, avg(accuracy) AS acc, avg(mcc) AS mcc, avg(recall_macro) AS rec, avg(precision_macro) AS prec FROM d GROUP BY 1, 2, 3)"""
_POINT_COLS = (
    [(f"{t}_f1_mean", f"(SELECT avg(f1) FROM pf WHERE pf.method = d.method AND task = '{t}')") for t in TASKS]
    + [(f"{t}_f1_std", f"(SELECT stddev_pop(f1) FROM pf WHERE pf.method = d.method AND task = '{t}')") for t in TASKS]
    + [(f"{t}_f1_{c}_mean", f"avg(f1_macro) FILTER (WHERE task = '{t}' AND clf = '{c}')") for t in TASKS for c in CLFS]
    + [(f"{t}_f1_{c}_std", f"stddev_pop(f1_macro) FILTER (WHERE task = '{t}' AND clf = '{c}')") for t in TASKS for c in CLFS]
    + [(n, f"(SELECT avg({c}) FROM pf WHERE pf.method = d.method AND task = 'multiclass')") for n, c in (("acc", "acc"), ("mcc", "mcc"), ("recall", "rec"), ("precision", "prec"))]
    + [(n, f"avg({c}) FILTER (WHERE task = 'multiclass' AND clf = 'rf')") for n, c in (("rf_recall", "recall_macro"), ("rf_precision", "precision_macro"), ("rf_mcc", "mcc"))]
)


@query(
    "natural_points",
    f"""WITH {fx.EVAL_LONG}, {_POINT_FOLD} SELECT method, count(DISTINCT fold) AS n_folds, {r('avg(n_features)')} AS n_features_mean, min(n_features) AS n_features_min,
    max(n_features) AS n_features_max, string_agg(DISTINCT clf, '/' ORDER BY clf) AS classifiers, {rr(_POINT_COLS)} FROM d GROUP BY method""",
)
def natural_points(spark, sf):
    return Rp.natural_points(fx.eval_long(spark, sf), "flows", METHODS)


REFS = ["all_features", "kmeans_sil", "mcfs_5"]
PK = "dataset, task, clf, reference"


@query(
    "significance",
    f"WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql()}, {compare_sql()} SELECT {PK}, '42' AS seeds, {REC_SQL} FROM rec",
)
def significance(spark, sf):
    return Rp.significance(fx.eval_long(spark, sf), REFS, [42])


@query(
    "significance_all_seeds",
    f"WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql('seed > 0')}, {compare_sql()} SELECT {PK}, '42+43+44' AS seeds, {REC_SQL} FROM rec",
)
def significance_all_seeds(spark, sf):
    return Rp.significance(fx.eval_long(spark, sf), REFS, None)


PAIR = ["proposed", "all_features"]
MULTI = f"""ms AS (SELECT seed, method, task, clf, avg(f1_macro) AS f1_mean, stddev_pop(f1_macro) AS f1_std, count(DISTINCT fold) AS n_folds, avg(n_features) AS nf_mean
    FROM eval_long WHERE {MAIN} AND method IN ({quoted(PAIR)}) AND clf IN ('rf', 'dt') GROUP BY 1, 2, 3, 4)"""


@query("multiseed", f"WITH {fx.EVAL_LONG}, {MULTI} SELECT seed, method, task, clf, {r('f1_mean')} AS f1_mean, {r('f1_std')} AS f1_std, n_folds, {r('nf_mean')} AS nf_mean FROM ms")
def multiseed(spark, sf):
    return Rp.multiseed(fx.eval_long(spark, sf), "flows", PAIR)


@query(
    "multiseed_pooled",
    f"""WITH {fx.EVAL_LONG}, {MULTI} SELECT method, task, clf, {r('avg(f1_mean)')} AS seed_mean, {r('stddev_samp(f1_mean)')} AS seed_std, {r('min(f1_mean)')} AS seed_min,
    {r('max(f1_mean)')} AS seed_max, count(DISTINCT seed) AS n_seeds FROM ms GROUP BY 1, 2, 3""",
)
def multiseed_pooled(spark, sf):
    return Rp.multiseed_pooled(Rp.multiseed(fx.eval_long(spark, sf), "flows", PAIR))


BUDGETS = [3, 5]
SEARCHES, RANKERS = ["proposed", "kmeans_sil"], ["mcfs", "variance", "laplacian"]
_NAMES = [(f"{m}_b{b}", m, b) for m in SEARCHES for b in BUDGETS] + [(f"{m}_{b}", m, b) for m in RANKERS for b in BUDGETS] + [("all_features", "all_features", b) for b in BUDGETS]
BUDGET = f"""sp(name, method, b) AS (VALUES {', '.join(f"('{n}', '{m}', {b})" for n, m, b in _NAMES)}),
    bc AS (SELECT sp.method, sp.b, f1_macro FROM sp LEFT JOIN eval_long e ON e.method = sp.name AND dataset = 'flows' AND protocol = 'sample_k10' AND variant = 'main' AND seed = 42
      AND task = 'multiclass' AND clf = 'rf' AND (sp.method = 'all_features' OR n_features = b)),
    bt AS (SELECT method, {', '.join(f"avg(f1_macro) FILTER (WHERE b = {b}) AS k{b}_mean, stddev_pop(f1_macro) FILTER (WHERE b = {b}) AS k{b}_std, count(f1_macro) FILTER (WHERE b = {b}) AS k{b}_n" for b in BUDGETS)} FROM bc GROUP BY 1)"""


def _budget(spark, sf):
    return Rp.budget_table(fx.eval_long(spark, sf), "flows", SEARCHES, RANKERS, BUDGETS)


@query("budget_table", f"WITH {fx.EVAL_LONG}, {BUDGET} SELECT method, {', '.join(f'{r(f"k{b}_mean")} AS k{b}_mean, {r(f"k{b}_std")} AS k{b}_std, k{b}_n' for b in BUDGETS)} FROM bt")
def budget_table(spark, sf):
    return _budget(spark, sf)


@query(
    "budget_delta",
    f"""WITH {fx.EVAL_LONG}, {BUDGET} SELECT method, {', '.join(f"method <> 'all_features' AND coalesce(abs(k{b}_mean - max(CASE WHEN method <> 'all_features' THEN k{b}_mean END) OVER ()) < 5e-4, false) AS best_k{b}" for b in BUDGETS)},
    CASE WHEN method <> 'all_features' THEN {r('k3_mean - k5_mean')} END AS delta FROM bt""",
)
def budget_delta(spark, sf):
    return Rp.budget_delta(_budget(spark, sf), BUDGETS)


@query(
    "protocol_table",
    f"""WITH {fx.EVAL_LONG} SELECT protocol, method, task, clf, {rr([('f1_mean', 'avg(f1_macro)'), ('f1_std', 'stddev_pop(f1_macro)'), ('acc', 'avg(accuracy)'), ('mcc', 'avg(mcc)'), ('recall', 'avg(recall_macro)'), ('nf', 'avg(n_features)')])},
    count(DISTINCT fold) AS n_folds FROM eval_long WHERE dataset = 'flows' AND variant = 'main' AND seed = 42 AND method IN ({quoted(PAIR)}) AND clf IN ('rf', 'dt') GROUP BY 1, 2, 3, 4""",
)
def protocol_table(spark, sf):
    return Rp.protocol_table(fx.eval_long(spark, sf), "flows", PAIR)


CLASSES = ["AF", "AO", "NF", "NO", "RF", "RO"]
CLASS_F1 = """cf AS (SELECT c.fold, c.cls, 2.0 * count(*) FILTER (WHERE y = cls AND p = cls) / greatest(1, count(*) FILTER (WHERE y = cls) + count(*) FILTER (WHERE p = cls)) AS f1
    FROM (SELECT f.fold, y.y AS cls FROM (SELECT DISTINCT fold FROM predictions) f CROSS JOIN (SELECT DISTINCT y FROM predictions) y) c JOIN predictions USING (fold) GROUP BY 1, 2)"""


@query(
    "per_class_table",
    f"""WITH {fx.PREDICTIONS}, {CLASS_F1}, ok AS (SELECT fold FROM cf GROUP BY 1 HAVING count(*) = 6)
    SELECT 'sample_k' || (fold % 2) AS protocol, {', '.join(f"{r(f'avg(f1) FILTER (WHERE cls = {chr(39)}{c}{chr(39)})')} AS {chr(34)}{c}{chr(34)}" for c in CLASSES)} FROM cf WHERE fold IN (SELECT fold FROM ok) GROUP BY 1""",
)
def per_class_table(spark, sf):
    rows = fx.predictions(spark, sf)
    scores = E.per_class_f1(E.confusion(rows, ["fold"]), ["fold"], E.fold_classes(rows))
    runs = scores.groupBy("fold").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cls", "f1"))), lambda s: s["f1"]).alias("per_class_f1")
    ).withColumn("protocol", F.concat(F.lit("sample_k"), F.col("fold") % 2))
    return Rp.per_class_table(runs, CLASSES)


PROXIES = ("proxy_in_sample", "proxy_heldout_internal", "proxy_heldout_test_fold")
EXTRAS = f"""ex AS (SELECT 42 + CAST(l_suppkey % 3 AS INTEGER) AS seed, CAST(l_partkey % 10 AS INTEGER) AS fold, CAST(sum(l_partkey + 7 * l_suppkey + 3 * l_linenumber) % 9973 AS BIGINT) AS h,
    {', '.join(f'count(*) FILTER (WHERE l_linenumber = {i}) AS s{i}' for i in range(1, 8))}, count(*) AS n FROM lineitem GROUP BY 1, 2),
    extras AS (SELECT CASE WHEN fold < 5 THEN 'sample_k10' ELSE 'group_exec_k5' END AS protocol, seed, fold, 7 AS k, (h % 97) / 100.0e0 AS silhouette, (h % 89) / 90.0e0 AS ari_resample, (h % 83) / 84.0e0 AS ami_resample,
    (h % 79) / 80.0e0 AS ari_resample_min, least({', '.join(f's{i}' for i in range(1, 8))}) / n AS min_cluster_share, greatest({', '.join(f's{i}' for i in range(1, 8))}) / n AS max_cluster_share,
    {', '.join(f'(h % {71 + 2 * j}) / 100.0e0 AS {t}_acc, (h % {61 + 2 * j}) / 100.0e0 AS {t}_bacc, (h % {51 + 2 * j}) / 100.0e0 AS {t}_f1' for j, t in enumerate(('ins', 'hoi', 'hot')))} FROM ex)"""
EXTRA_COLS = ["silhouette", "ari_resample", "ami_resample", "ari_resample_min", "min_cluster_share", "max_cluster_share"] + [f"{t}_{m}" for t in ("ins", "hoi", "hot") for m in ("acc", "bacc", "f1")]


def _extras(spark, sf):
    line = fx.read(spark, sf, "lineitem")
    runs = line.groupBy((42 + F.col("l_suppkey") % 3).cast("int").alias("seed"), (F.col("l_partkey") % 10).cast("int").alias("fold")).agg(
        (F.sum(F.col("l_partkey") + 7 * F.col("l_suppkey") + 3 * F.col("l_linenumber")) % 9973).alias("h"),
        F.array(*[F.sum((F.col("l_linenumber") == i).cast("long")) for i in range(1, 8)]).alias("sizes"),
    )
    share = lambda m, d: (F.col("h") % m) / F.lit(float(d))
    proxy = lambda j: F.struct(F.col("h").alias("n"), share(71 + 2 * j, 100).alias("accuracy"), share(61 + 2 * j, 100).alias("balanced_accuracy"), share(51 + 2 * j, 100).alias("macro_f1"))
    body = F.struct(
        F.lit(7).alias("k"), F.col("sizes").alias("cluster_sizes"), share(97, 100).alias("silhouette"),
        F.struct(share(89, 90).alias("ari_mean"), share(79, 80).alias("ari_min"), share(83, 84).alias("ami_mean")).alias("stability_resample"),
        *[proxy(j).alias(p) for j, p in enumerate(PROXIES)],
    )
    protocol = F.when(F.col("fold") < 5, "sample_k10").otherwise("group_exec_k5").alias("protocol")
    return Rp.extras_table(runs.select(protocol, "seed", "fold", F.to_json(body).alias("value")))


@query("extras_table", f"WITH {EXTRAS} SELECT protocol, seed, fold, k, {', '.join(r(c) + ' AS ' + c for c in EXTRA_COLS)} FROM extras")
def extras_table(spark, sf):
    return _extras(spark, sf)


@query(
    "extras_summary",
    f"""WITH {EXTRAS} SELECT protocol, {rr([x for c in ['k', *EXTRA_COLS] for x in ((f'{c}_mean', f'avg({c})'), (f'{c}_std', f'stddev_samp({c})'))])},
    min(k) AS k_min, {rr([(f'{c}_min', f'min({c})') for c in EXTRA_COLS])} FROM extras GROUP BY 1""",
)
def extras_summary(spark, sf):
    return Rp.extras_summary(_extras(spark, sf))


VARIANT_LABEL = {"main": "Group masking", "aug_independent": "Independent masking, matched rate", "aug_none": "No masking"}
CONTROL_LABEL = {
    "proposed_backward_only": "Backward-only search", "kmeans_sil_at_nprop": "Raw-space search at the latent size",
    "kmeans_sil": "Raw-space search (natural)", "all_features": "All features",
}
_cells = [f"avg(f1_macro) FILTER (WHERE method = 'proposed' AND task = '{t}' AND clf = '{c}')" for t in TASKS for c in ("rf", "dt")]
_names = [f"{t}_{c}" for t in TASKS for c in ("rf", "dt")]


@query(
    "ablation_table",
    f"""WITH {fx.EVAL_LONG}, d AS (SELECT * FROM eval_long WHERE dataset = 'flows' AND protocol = 'sample_k10' AND seed = 42),
    c AS (SELECT * FROM d WHERE fold IN (SELECT fold FROM eval_long WHERE dataset = 'flows' AND variant = 'aug_independent' AND method = 'proposed'))
    SELECT CASE variant {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in VARIANT_LABEL.items())} END AS configuration, count(DISTINCT fold) AS n_folds,
    {r("avg(n_features) FILTER (WHERE method = 'proposed')")} AS n_features, {rr(list(zip(_names, _cells)))},
    {rr([(f'rf_b{b}', f"avg(f1_macro) FILTER (WHERE method = 'proposed_b{b}' AND task = 'multiclass' AND clf = 'rf')") for b in BUDGETS])}
    FROM c GROUP BY variant
    UNION ALL SELECT CASE method {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTROL_LABEL.items())} END, count(DISTINCT fold), {r('avg(n_features)')},
    {r("avg(f1_macro) FILTER (WHERE task = 'binary' AND clf = 'rf')")}, NULL, {r("avg(f1_macro) FILTER (WHERE task = 'multiclass' AND clf = 'rf')")}, NULL, NULL, NULL
    FROM d WHERE variant = 'main' AND method IN ({quoted(CONTROL_LABEL)}) GROUP BY method""",
)
def ablation_table(spark, sf):
    return Rp.ablation_table(fx.eval_long(spark, sf), "flows", VARIANT_LABEL, CONTROL_LABEL, BUDGETS)


def _sc(name: str, where: str) -> str:
    return f"{name} AS (SELECT task, clf, fold, f1_macro AS v, n_features AS nf FROM d WHERE {where})"


_PAIRS = f"""d AS (SELECT * FROM eval_long WHERE dataset = 'flows' AND protocol = 'sample_k10' AND seed = 42),
    {_sc('nat', "variant = 'main' AND method = 'proposed' AND clf IN ('rf', 'dt')")}, {_sc('ind', "variant = 'aug_independent' AND method = 'proposed' AND clf IN ('rf', 'dt')")},
    {_sc('base', "variant = 'main' AND method = 'proposed' AND clf = 'rf'")}, {_sc('bo', "variant = 'main' AND method = 'proposed_backward_only' AND clf = 'rf'")},
    {_sc('rawn', "variant = 'main' AND method = 'kmeans_sil' AND clf = 'rf'")}, {_sc('rawp', "variant = 'main' AND method = 'kmeans_sil_at_nprop' AND clf = 'rf'")},
    {', '.join(_sc(f'm{b}', f"variant = 'main' AND method = 'proposed_b{b}' AND clf = 'rf' AND task = 'multiclass'") for b in BUDGETS)},
    {', '.join(_sc(f'i{b}', f"variant = 'aug_independent' AND method = 'proposed_b{b}' AND clf = 'rf' AND task = 'multiclass'") for b in BUDGETS)},
    {', '.join(_sc(f'k{b}', f"variant = 'main' AND method = 'kmeans_sil_b{b}' AND clf = 'rf' AND task = 'multiclass'") for b in BUDGETS)},
    back AS (SELECT * FROM bo UNION ALL SELECT * FROM base WHERE (task, fold) NOT IN (SELECT (task, fold) FROM bo)),
    raw AS (SELECT * FROM rawp UNION ALL SELECT rawn.* FROM rawn JOIN base USING (task, fold) WHERE rawn.nf = base.nf AND (task, fold) NOT IN (SELECT (task, fold) FROM rawp)),
    pairs AS (SELECT 'group vs independent masking (natural subset)' AS comparison, task, clf, fold, nat.v AS a, ind.v AS b FROM nat JOIN ind USING (task, clf, fold)
      {' '.join(f"UNION ALL SELECT 'group vs independent masking (budget k={b})', task, clf, fold, m{b}.v, i{b}.v FROM m{b} JOIN i{b} USING (task, clf, fold)" for b in BUDGETS)}
      UNION ALL SELECT 'bidirectional vs backward-only', task, clf, fold, base.v, back.v FROM base JOIN back USING (task, clf, fold)
      UNION ALL SELECT 'latent vs raw search at the same size', task, clf, fold, base.v, raw.v FROM base JOIN raw USING (task, clf, fold)
      {' '.join(f"UNION ALL SELECT 'latent vs raw search (budget k={b})', task, clf, fold, m{b}.v, k{b}.v FROM m{b} JOIN k{b} USING (task, clf, fold) WHERE m{b}.nf = {b} AND k{b}.nf = {b}" for b in BUDGETS)})"""


@query(
    "ablation_paired",
    f"""WITH RECURSIVE {fx.EVAL_LONG}, {_PAIRS}, {compare_sql(keys='comparison, task, clf', tie='1e-12')}
    SELECT comparison, task, clf, n_pairs, n_positive, n_negative, {rr([(c, c) for c in ('mean_a', 'mean_b', 'mean_diff', 'wilcoxon_p', 'tost_p')])} FROM rec WHERE n_pairs >= 5""",
)
def ablation_paired(spark, sf):
    return Rp.ablation_paired(fx.eval_long(spark, sf), "flows", BUDGETS, BUDGETS)


_VAR = "sv AS (SELECT CASE seed WHEN 42 THEN 'main' WHEN 43 THEN 'aug_independent' ELSE 'aug_none' END AS variant, * FROM selections WHERE fold < 5)"


@query(
    "ablation_selection",
    f"""WITH {fx.SELECTIONS}, {_VAR}, {jaccard_sql('sv', 'variant')}, {nogueira_sql('sv', 'variant')},
    z AS (SELECT variant, run_id, any_value(k_star) AS k, count(*) AS n FROM sv GROUP BY 1, 2),
    zz AS (SELECT variant, count(*) AS n_runs, avg(n) AS size_mean, min(n) AS size_min, max(n) AS size_max, string_agg(k, ',' ORDER BY k) AS k_star FROM z GROUP BY 1)
    SELECT variant, zz.n_runs, {r('size_mean')} AS size_mean, size_min, size_max, {r('(SELECT avg(jaccard) FROM jp WHERE jp.variant = zz.variant)')} AS jaccard_mean, {r('nogueira')} AS nogueira, k_star
    FROM zz JOIN nog USING (variant)""",
)
def ablation_selection(spark, sf):
    variant = F.when(F.col("seed") == 42, "main").when(F.col("seed") == 43, "aug_independent").otherwise("aug_none")
    return Rp.ablation_selection(fx.selections(spark, sf).withColumn("variant", variant), D)


METRICS = ["f1_macro", "accuracy", "precision_macro", "recall_macro", "mcc"]
CV = f"""cv AS (SELECT method, clf, task, avg(n_features) AS n_features, 1 - avg(n_features) / 12 AS reduction_ratio,
    {', '.join(f'avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std' for m in METRICS)} FROM eval_long WHERE {MAIN} AND seed = 42 GROUP BY 1, 2, 3),
    cvm AS (SELECT * FROM cv WHERE task = 'multiclass')"""


def _cv(spark, sf):
    ev = fx.eval_long(spark, sf).filter(MAIN).filter("seed = 42")
    return Rp.fold_summary(ev, ["method", "clf", "task"], D)


def _cvm(spark, sf):
    return _cv(spark, sf).filter("task = 'multiclass'")


@query("fold_summary", f"WITH {fx.EVAL_LONG}, {CV} SELECT method, clf, task, {rr([(c, c) for c in ['n_features', 'reduction_ratio'] + [f'{m}_{s}' for m in METRICS for s in ('mean', 'std')]])} FROM cv")
def fold_summary(spark, sf):
    return _cv(spark, sf)


@query(
    "mean_over_classifiers",
    f"""WITH {fx.EVAL_LONG}, {CV} SELECT method, {rr([('n_features', 'avg(n_features)'), ('f1_mean', 'avg(f1_macro_mean)'), ('f1_std', 'avg(f1_macro_std)'), ('acc_mean', 'avg(accuracy_mean)'), ('mcc_mean', 'avg(mcc_mean)')])} FROM cvm GROUP BY 1""",
)
def mean_over_classifiers(spark, sf):
    return Rp.mean_over_classifiers(_cvm(spark, sf))


@query(
    "best_classifier",
    f"""WITH {fx.EVAL_LONG}, {CV}, b AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1_macro_mean DESC, clf DESC) AS rn,
      max(accuracy_mean) OVER (PARTITION BY method) AS acc, max(mcc_mean) OVER (PARTITION BY method) AS mcc FROM cvm)
    SELECT method, clf AS best_clf, {rr([('f1_mean', 'f1_macro_mean'), ('f1_std', 'f1_macro_std'), ('acc_mean', 'acc'), ('mcc_mean', 'mcc')])} FROM b WHERE rn = 1""",
)
def best_classifier(spark, sf):
    return Rp.best_classifier(_cvm(spark, sf))


ORDER = ["proposed", "kmeans_sil", "variance_5", "laplacian_5", "mcfs_5", "all_features"]


@query(
    "method_scenario_pivot",
    f"""WITH {fx.EVAL_LONG}, {CV}, s AS (SELECT method, task, avg(n_features) AS nf, avg(f1_macro_mean) AS f1, avg(f1_macro_std) AS sd FROM cv GROUP BY 1, 2),
    p AS (SELECT method, avg(nf) AS n_features, {', '.join(f"avg(f1) FILTER (WHERE task = '{t}') AS {t}_f1, avg(sd) FILTER (WHERE task = '{t}') AS {t}_std" for t in TASKS)} FROM s GROUP BY 1)
    SELECT method, {rr([(c, c) for c in ['n_features'] + [f'{t}_{x}' for t in TASKS for x in ('f1', 'std')]])},
    CAST(row_number() OVER (ORDER BY CASE method {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(ORDER))} ELSE 99 END, method) AS INTEGER) AS rank FROM p""",
)
def method_scenario_pivot(spark, sf):
    return Rp.method_scenario_pivot(_cv(spark, sf), ORDER, list(TASKS))


@query(
    "method_classifier_pivot",
    f"""WITH {fx.EVAL_LONG}, {CV}, p AS (SELECT method, {', '.join(f"avg(f1_macro_mean) FILTER (WHERE clf = '{c}') AS {c}" for c in CLFS)}, (sum(f1_macro_mean) FILTER (WHERE clf = 'rf')
      + sum(f1_macro_mean) FILTER (WHERE clf = 'dt') + sum(f1_macro_mean) FILTER (WHERE clf = 'knn')) / 3 AS row_mean FROM cvm GROUP BY 1)
    SELECT method, {rr([(c, c) for c in (*CLFS, 'row_mean')])}, CAST(row_number() OVER (ORDER BY row_mean DESC, method) AS INTEGER) AS rank FROM p""",
)
def method_classifier_pivot(spark, sf):
    return Rp.method_classifier_pivot(_cvm(spark, sf))


STEPS = {"all": ["all_features"], "static": ["mcfs_5", "variance_5", "laplacian_5"], "raw": ["kmeans_sil"], "proposed": ["proposed"]}


@query(
    "step_deltas",
    f"""WITH {fx.EVAL_LONG}, {CV}, sp(step, name, method) AS (VALUES {', '.join(f"({i}, '{n}', '{m}')" for i, (n, ms) in enumerate(STEPS.items()) for m in ms)}),
    m AS (SELECT method, avg(f1_macro_mean) AS value FROM cvm GROUP BY 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY value DESC, method DESC) AS rn FROM sp JOIN m USING (method))
    SELECT step, name, method, {r('value')} AS value, {r('coalesce(value - lag(value) OVER (ORDER BY step), 0)')} AS delta FROM b WHERE rn = 1""",
)
def step_deltas(spark, sf):
    return Rp.step_deltas(_cvm(spark, sf), STEPS)


@query(
    "gain_over_best",
    f"""WITH {fx.EVAL_LONG}, {CV}, m AS (SELECT method, avg(f1_macro_mean) AS v FROM cvm GROUP BY 1),
    g AS (SELECT max(v) FILTER (WHERE method = 'proposed') AS p, max(v) FILTER (WHERE method NOT IN ('proposed', 'all_features')) AS b FROM m)
    SELECT {r('p')} AS proposed, {r('b')} AS best_baseline, {r('p - b')} AS gain FROM g""",
)
def gain_over_best(spark, sf):
    return Rp.gain_over_best(_cvm(spark, sf), "proposed", ["all_features"])


@query(
    "k_sweep_curve",
    f"""WITH {fx.EVAL_LONG}, {CV} SELECT regexp_replace(method, '_[kb]?\\d+$', '') AS base, CAST(regexp_extract(method, '_[kb]?(\\d+)$', 1) AS INTEGER) AS k,
    {rr([('f1_mean', 'avg(f1_macro_mean)'), ('f1_std', 'avg(f1_macro_std)'), ('lower', 'avg(f1_macro_mean - f1_macro_std)'), ('upper', 'avg(f1_macro_mean + f1_macro_std)')])}
    FROM cvm WHERE clf = 'rf' AND regexp_matches(method, '_[kb]?\\d+$') GROUP BY 1, 2""",
)
def k_sweep_curve(spark, sf):
    return Rp.k_sweep_curve(_cvm(spark, sf))


@query(
    "often_removed",
    f"""WITH {fx.SELECTIONS}, {fx.FEATURE_DIM}, {FREQ} SELECT CAST(row_number() OVER (ORDER BY selection_frequency, pos) AS INTEGER) AS rank, feature, grp, n_runs - n_selected AS n_removed, n_runs,
    pos NOT IN (SELECT pos FROM selections WHERE run_id = 420) AS removed_now, feature IN ({quoted(fx.REFERENCE_SET)}) AS in_reference FROM freq WHERE selection_frequency < 0.8""",
)
def often_removed(spark, sf):
    sel, dim = fx.selections(spark, sf), fx.feature_dim(spark)
    gone = removed_features(sel.filter("run_id = 420"), dim, fx.REFERENCE_SET)
    return Rp.often_removed(St.selection_frequency(sel, dim), gone, fx.REFERENCE_SET)


_V = """CASE WHEN wilcoxon_p < 0.05 AND mean_diff > 0 THEN CASE WHEN tost_p < 0.05 THEN 'Superior (equiv.)' ELSE 'Superior' END
    WHEN wilcoxon_p < 0.05 AND mean_diff < 0 THEN CASE WHEN tost_p < 0.05 THEN 'Inferior (equiv.)' ELSE 'Inferior' END
    WHEN tost_p < 0.05 THEN 'Equivalent' ELSE 'Inconclusive' END"""


@query(
    "cross_dataset",
    f"""WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql()}, {compare_sql()}, v AS (SELECT *, {_V} AS verdict FROM rec WHERE clf = 'rf')
    SELECT dataset, reference, {', '.join(f"{r(f'max({s}) FILTER (WHERE task = {chr(39)}{t}{chr(39)})')} AS {t}_{d}" for t in TASKS for s, d in (('mean_diff', 'diff'), ('wilcoxon_p', 'wilcoxon'), ('tost_p', 'tost')))},
    {', '.join(f"max(verdict) FILTER (WHERE task = '{t}') AS {t}_verdict" for t in TASKS)} FROM v GROUP BY 1, 2""",
)
def cross_dataset(spark, sf):
    return Rp.cross_dataset(Rp.significance(fx.eval_long(spark, sf), REFS, [42]))


_SEED_COLS = [(f"{m}_{t}_rf{x}", f"max({c}) FILTER (WHERE method = '{m}' AND task = '{t}' AND clf = 'rf')") for t in TASKS for m in PAIR for x, c in (("", "f1_mean"), ("_std", "f1_std"))] + [
    (f"{m}_multiclass_dt", f"max(f1_mean) FILTER (WHERE method = '{m}' AND task = 'multiclass' AND clf = 'dt')") for m in PAIR
]


@query(
    "seeds_table",
    f"""WITH {fx.EVAL_LONG}, {MULTI}, {fx.SELECTIONS.split(', selections AS', 1)[1].join(['selections AS', ''])},
    z AS (SELECT seed, run_id, k_star, count(*) AS n FROM selections GROUP BY 1, 2, 3),
    zs AS (SELECT seed, avg(n) AS sm, min(n) AS size_min, max(n) AS size_max, min(k_star) AS k_min, max(k_star) AS k_max FROM z GROUP BY 1),
    sc AS (SELECT seed, {rr(_SEED_COLS)} FROM ms GROUP BY 1)
    SELECT zs.seed, {r('sm')} AS size_mean, size_min, size_max, k_min, k_max, sc.* EXCLUDE (seed) FROM zs JOIN sc USING (seed)""",
)
def seeds_table(spark, sf):
    return Rp.seeds_table(Rp.multiseed(fx.eval_long(spark, sf), "flows", PAIR), fx.selections(spark, sf), D, PAIR)
