"""Registered queries: subset stability, search logs, coverage, plans and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from telesift.operators import coverage as C
from telesift.operators import history as Hs
from telesift.operators import stability as St
from telesift.plans import fixtures as fx
from telesift.plans.registry import query, r
from telesift.sources.runs import RUN_KEYS

D = len(fx.FEATURES)


@query(
    "run_sizes",
    f"WITH {fx.SELECTIONS} SELECT run_id, seed, fold, count(*) AS n_selected, 12 - count(*) AS n_removed FROM selections GROUP BY 1, 2, 3",
)
def run_sizes(spark, sf):
    return St.run_sizes(fx.selections(spark, sf), D)


SIZES = "sz AS (SELECT {by} run_id, count(*) AS n FROM {src} GROUP BY ALL)"


@query(
    "subset_sizes",
    f"""WITH {fx.SELECTIONS}, {SIZES.format(by='', src='selections')} SELECT count(*) AS n_runs, {r('avg(n)')} AS size_mean, {r('stddev_pop(n)')} AS size_std,
    min(n) AS size_min, {r('median(n)')} AS size_median, max(n) AS size_max FROM sz""",
)
def subset_sizes(spark, sf):
    return St.subset_sizes(fx.selections(spark, sf), D)


FREQ = f"""runs AS (SELECT DISTINCT run_id, seed FROM selections),
    freq AS (SELECT f.pos, f.feature, f.grp, count(s.run_id) AS n_selected, (SELECT count(*) FROM runs) AS n_runs,
      count(s.run_id) / (SELECT count(*) FROM runs) AS selection_frequency,
      {', '.join(f"count(s.run_id) FILTER (WHERE s.seed = {s}) / (SELECT count(*) FROM runs WHERE seed = {s}) AS freq_seed{s}" for s in (42, 43, 44))}
      FROM feature_dim f LEFT JOIN selections s USING (pos) GROUP BY 1, 2, 3)"""


def _freq(spark, sf):
    return St.selection_frequency(fx.selections(spark, sf), fx.feature_dim(spark))


@query(
    "selection_frequency",
    f"""WITH {fx.SELECTIONS}, {fx.FEATURE_DIM}, {FREQ} SELECT pos, feature, grp, n_selected, n_runs, {r('selection_frequency')} AS selection_frequency,
    {', '.join(r(f'freq_seed{s}') + f' AS freq_seed{s}' for s in (42, 43, 44))} FROM freq""",
)
def selection_frequency(spark, sf):
    return _freq(spark, sf)


@query(
    "frequency_counts",
    f"""WITH {fx.SELECTIONS}, {fx.FEATURE_DIM}, {FREQ} SELECT count(*) FILTER (WHERE selection_frequency = 1) AS n_always,
    count(*) FILTER (WHERE selection_frequency = 0) AS n_never, count(*) FILTER (WHERE selection_frequency >= 0.8) AS n_often FROM freq""",
)
def frequency_counts(spark, sf):
    return St.frequency_counts(_freq(spark, sf))


def jaccard_sql(src: str = "selections", by: str = "") -> str:
    b = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    bb = f"a.{by}, " if by else ""
    return f"""sets0 AS (SELECT {b}run_id, seed, list(DISTINCT pos) AS s FROM {src} GROUP BY {b}run_id, seed),
    sets AS (SELECT *, list_filter(CAST(range(12) AS INTEGER[]), lambda x: NOT list_contains(s, x)) AS rest FROM sets0),
    jp AS (SELECT {bb}a.run_id AS run_id_a, b.run_id AS run_id_b, a.seed = b.seed AS same_seed,
      CASE WHEN len(list_distinct(a.s || b.s)) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) END AS jaccard,
      CASE WHEN len(list_distinct(a.rest || b.rest)) = 0 THEN 1.0 ELSE len(list_intersect(a.rest, b.rest)) / len(list_distinct(a.rest || b.rest)) END AS jaccard_removed
      FROM sets a JOIN sets b ON {on}a.run_id < b.run_id)"""


@query("jaccard_pairs", f"WITH {fx.SELECTIONS}, {jaccard_sql()} SELECT run_id_a, run_id_b, same_seed, {r('jaccard')} AS jaccard, {r('jaccard_removed')} AS jaccard_removed FROM jp")
def jaccard_pairs(spark, sf):
    return St.jaccard_pairs(fx.selections(spark, sf), D)


@query(
    "jaccard_summary",
    f"""WITH {fx.SELECTIONS}, {jaccard_sql()} SELECT {r('avg(jaccard) FILTER (WHERE same_seed)')} AS within_seed_mean, {r('min(jaccard) FILTER (WHERE same_seed)')} AS within_seed_min,
    {r('avg(jaccard) FILTER (WHERE NOT same_seed)')} AS across_seed_mean, {r('avg(jaccard)')} AS all_mean, {r('avg(jaccard_removed)')} AS removed_all_mean FROM jp""",
)
def jaccard_summary(spark, sf):
    return St.jaccard_summary(St.jaccard_pairs(fx.selections(spark, sf), D))


def nogueira_sql(src: str = "selections", by: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    j = f"JOIN nr USING ({by})" if by else "CROSS JOIN nr"
    return f"""nr AS (SELECT {b}count(DISTINCT run_id) AS m, count(*) / count(DISTINCT run_id) / 12.0 AS share FROM {src}{g}),
    nh AS (SELECT {b}pos, count(*) AS c FROM {src} GROUP BY {b}pos),
    nog AS (SELECT {b}max(m) AS n_runs, CASE WHEN max(m) > 1 AND max(share) * (1 - max(share)) <> 0
      THEN 1 - sum(m / (m - 1) * (c / m) * (1 - c / m)) / 12.0 / (max(share) * (1 - max(share))) END AS nogueira FROM nh {j}{g})"""


@query("nogueira", f"WITH {fx.SELECTIONS}, {nogueira_sql(by='seed')} SELECT seed, n_runs, {r('nogueira')} AS nogueira FROM nog")
def nogueira(spark, sf):
    return St.nogueira(fx.selections(spark, sf), D, ["seed"])


@query(
    "k_counts",
    f"""WITH {fx.SELECTIONS}, ks AS (SELECT k_star, count(*) AS n FROM (SELECT DISTINCT run_id, k_star FROM selections) GROUP BY 1)
    SELECT string_agg(k_star || ':' || n, ',' ORDER BY k_star) AS k_counts, CAST(sum(n) AS BIGINT) AS n_runs FROM ks""",
)
def k_counts(spark, sf):
    return St.k_counts(fx.selections(spark, sf).select("run_id", "k_star").distinct())


# ---------------------------------------------------------------- search logs and subsets


@query(
    "path_subsets",
    f"""WITH {fx.HISTORY}, st AS (SELECT DISTINCT run_id, step AS t FROM history),
    ev AS (SELECT run_id, pos, step, action FROM history WHERE pos IS NOT NULL UNION ALL
           SELECT DISTINCT run_id, CAST(p AS INTEGER), 0, 'add' FROM history, (SELECT unnest(range(12)) AS p)),
    mem AS (SELECT st.run_id, st.t, pos, arg_max(action, step) AS a FROM st JOIN ev ON st.run_id = ev.run_id AND ev.step <= st.t GROUP BY 1, 2, 3),
    sub AS (SELECT run_id, t, count(*) AS n, string_agg(pos, ',' ORDER BY pos) AS subset FROM mem WHERE a = 'add' GROUP BY 1, 2)
    SELECT run_id, n, arg_max(subset, t) AS subset, max(t) AS step FROM sub GROUP BY 1, 2""",
)
def path_subsets(spark, sf):
    return Hs.path_subsets(fx.history(spark, sf), D)


@query(
    "search_summary",
    f"""WITH {fx.HISTORY} SELECT run_id, max(step) AS n_steps, count(*) FILTER (WHERE action = 'remove') AS n_removals,
    count(*) FILTER (WHERE action = 'add') AS n_forward_additions, arg_max(n, step) AS n_selected, {r('1 - arg_max(n, step) / 12.0')} AS reduction_ratio,
    {r('arg_min(j, step)')} AS j_full, {r('arg_max(j, step)')} AS j_selected FROM history GROUP BY 1""",
)
def search_summary(spark, sf):
    return Hs.search_summary(fx.history(spark, sf), D)


@query(
    "complete_ranking",
    f"""WITH {fx.SELECTIONS}, freq AS (SELECT pos, count(*) AS n, CAST(sum(fold) AS DOUBLE) / count(*) AS var FROM selections GROUP BY 1),
    rk AS (SELECT pos, var, row_number() OVER (ORDER BY n DESC, pos DESC) AS rank, n > 20 AS chosen FROM freq)
    SELECT CAST(row_number() OVER (ORDER BY chosen DESC, CASE WHEN chosen THEN -var END, CASE WHEN chosen THEN -pos ELSE rank END) AS INTEGER) AS rank, pos, chosen FROM rk""",
)
def complete_ranking(spark, sf):
    stats = fx.selections(spark, sf).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("fold").cast("double") / F.count(F.lit(1))).alias("var")
    )
    from pyspark.sql import Window

    ranking = stats.select("pos", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("pos"))).alias("rank"))
    return Hs.complete_ranking(stats.filter("n > 20"), ranking, stats)


def _chosen(spark, sf):
    return fx.selections(spark, sf).filter("run_id = 420")


@query(
    "removed_features",
    f"""WITH {fx.SELECTIONS}, {fx.FEATURE_DIM} SELECT pos, feature, grp, feature IN ({', '.join(f"'{f}'" for f in fx.REFERENCE_SET)}) AS in_reference
    FROM feature_dim WHERE pos NOT IN (SELECT pos FROM selections WHERE run_id = 420)""",
)
def removed_features(spark, sf):
    return C.removed_features(_chosen(spark, sf), fx.feature_dim(spark), fx.REFERENCE_SET)


METHOD_OF_FOLD = {0: "proposed", 1: "variance", 2: "laplacian", 3: "spec", 4: "mcfs", 5: "ndfs", 6: "raw"}
METHODS_SQL = f"""sets AS (SELECT m.method, s.pos FROM selections s JOIN (VALUES {', '.join(f"({k}, '{v}')" for k, v in METHOD_OF_FOLD.items())}) AS m(fold, method) USING (fold)
    WHERE s.seed = 42)"""


def _method_sets(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in METHOD_OF_FOLD.items() for x in kv])
    return fx.selections(spark, sf).filter("seed = 42").withColumn("method", names[F.col("fold")]).filter("method IS NOT NULL").select("method", "pos")


COVER = ["proposed", "variance", "mcfs"]


@query(
    "group_coverage",
    f"""WITH {fx.SELECTIONS}, {fx.FEATURE_DIM}, {METHODS_SQL} SELECT coalesce(grp, 'TOTAL') AS grp, count(DISTINCT pos) AS total,
    {', '.join(f"count(*) FILTER (WHERE method = '{m}') AS {m}" for m in COVER)}
    FROM feature_dim LEFT JOIN sets USING (pos) GROUP BY ROLLUP (grp)""",
)
def group_coverage(spark, sf):
    return C.group_coverage(_method_sets(spark, sf), fx.feature_dim(spark), COVER)


VOTERS = ["variance", "laplacian", "spec", "mcfs", "ndfs"]


@query(
    "consensus",
    f"""WITH {fx.SELECTIONS}, {fx.FEATURE_DIM}, {METHODS_SQL}, v AS (SELECT pos, feature,
      count(DISTINCT method) FILTER (WHERE method IN ({', '.join(f"'{v}'" for v in VOTERS)})) AS votes,
      count(*) FILTER (WHERE method = 'proposed') > 0 AS in_proposed, count(*) FILTER (WHERE method = 'raw') > 0 AS in_raw
      FROM feature_dim LEFT JOIN sets USING (pos) GROUP BY 1, 2)
    SELECT pos, feature, votes, votes >= 3 AS majority, votes = 5 AS unanimous, in_proposed, in_raw,
    in_proposed AND votes = 0 AS only_proposed, in_raw AND votes = 0 AS only_raw FROM v""",
)
def consensus(spark, sf):
    return C.consensus(_method_sets(spark, sf), fx.feature_dim(spark), VOTERS, ["proposed", "raw"])


# ---------------------------------------------------------------- plans

FAMILY = """CASE WHEN method = 'proposed' THEN 'proposed' WHEN method = 'all_features' THEN 'all' WHEN method = 'kmeans_sil' THEN 'search'
    WHEN method LIKE '%\\_b_' ESCAPE '\\' THEN 'budget' WHEN method IN ('kmeans_sil_at_nprop', 'proposed_backward_only') THEN 'control' ELSE 'ranking' END"""
MAIN = "dataset = 'flows' AND protocol = 'sample_k10' AND variant = 'main'"


def _plan_sets(spark, sf):
    ev = fx.eval_long(spark, sf).filter(MAIN)
    m = F.col("method")
    family = (
        F.when(m == "proposed", "proposed").when(m == "all_features", "all").when(m == "kmeans_sil", "search")
        .when(m.rlike("_b[0-9]$"), "budget").when(m.isin("kmeans_sil_at_nprop", "proposed_backward_only"), "control").otherwise("ranking")
    )
    budget = F.expr("try_cast(regexp_extract(method, '_b([0-9]+)$', 1) AS int)")
    return ev.select((F.col("seed") * 10 + F.col("fold")).alias("run_id"), "method", "fold").distinct().withColumn("family", family).withColumn("budget", budget)


PLAN_SETS = f"""sets AS (SELECT DISTINCT seed * 10 + fold AS run_id, method, fold, {FAMILY} AS family FROM eval_long WHERE {MAIN}),
    todo AS (SELECT * FROM sets WHERE NOT (fold < 3 AND family IN ('proposed', 'ranking')))"""


@query(
    "eval_plan",
    f"""WITH {fx.EVAL_LONG}, {PLAN_SETS}
    SELECT run_id, method, clf, task FROM todo, (VALUES ('rf'), ('dt'), ('knn')) AS c(clf), (VALUES ('binary'), ('multiclass')) AS t(task)
    WHERE (family NOT IN ('control', 'budget') OR clf = 'rf') AND (family <> 'budget' OR task = 'multiclass')""",
)
def eval_plan(spark, sf):
    sets = _plan_sets(spark, sf)
    return Hs.eval_plan(sets, sets.filter("fold < 3 AND family IN ('proposed', 'ranking')"), "full")


@query(
    "eval_plan_ablation",
    f"""WITH {fx.EVAL_LONG}, {PLAN_SETS}
    SELECT run_id, method, clf, task FROM todo, (VALUES ('rf'), ('dt')) AS c(clf), (VALUES ('binary'), ('multiclass')) AS t(task)
    WHERE method IN ('proposed', 'proposed_b3', 'proposed_b5') AND (family <> 'budget' OR (clf = 'rf' AND task = 'multiclass'))""",
)
def eval_plan_ablation(spark, sf):
    sets = _plan_sets(spark, sf)
    return Hs.eval_plan(
        sets, sets.filter("fold < 3 AND family IN ('proposed', 'ranking')"), "ablation", "aug_independent", budgets=(3, 5)
    )


@query(
    "usable_labels",
    f"""WITH {fx.FLOWS}, c AS (SELECT 1 AS pref, 'edge_label' AS label, 1 AS n UNION ALL SELECT 2, 'label1', count(DISTINCT label1) FROM flows
      UNION ALL SELECT 3, 'label2', count(DISTINCT label2) FROM flows UNION ALL SELECT 4, 'device_name', count(DISTINCT device_name) FROM flows)
    SELECT CAST(row_number() OVER (ORDER BY pref) AS INTEGER) AS rank, label, n AS n_classes FROM c WHERE n >= 2 ORDER BY 1 LIMIT 2""",
)
def usable_labels(spark, sf):
    df = fx.flows(spark, sf).withColumn("edge_label", F.lit("same"))
    return Hs.usable_labels(df, ["not_there", "edge_label", "label1", "label2", "device_name"])


GRID = [
    (1, "windows", "sample_k10", 10, 42, 10, "full", "main"),
    (2, "flows", "sample_k10", 10, 42, 10, "full", "main"),
    (3, "flows", "sample_k10", 10, 45, 10, "seed", "main"),
    (4, "flows", "group_exec_k5", 5, 42, 5, "seed", "main"),
    (5, "flows", "sample_k10", 10, 42, 10, "ablation", "aug_independent"),
]


@query(
    "experiment_grid",
    f"""WITH {fx.EVAL_LONG}, g(priority, dataset, protocol, n_splits, seed, n_folds, level, variant) AS (VALUES {fx._values(GRID)}),
    j AS (SELECT g.*, CAST(f AS INTEGER) AS fold FROM g, (SELECT unnest(range(10)) AS f) WHERE f < n_folds)
    SELECT priority, dataset, protocol, seed, fold, variant, n_splits, level FROM j
    WHERE NOT EXISTS (SELECT 1 FROM eval_long e WHERE e.dataset = j.dataset AND e.protocol = j.protocol AND e.seed = j.seed AND e.fold = j.fold AND e.variant = j.variant AND e.fold <> 7)""",
)
def experiment_grid(spark, sf):
    done = fx.eval_long(spark, sf).select(*RUN_KEYS).filter("fold <> 7")
    return Hs.experiment_grid(spark.createDataFrame(GRID, Hs.GRID_SCHEMA), done)


# ---------------------------------------------------------------- paired tests

REFS = ["all_features", "kmeans_sil", "mcfs_5"]
PK = ["dataset", "task", "clf", "reference"]
PKS = ", ".join(PK)


def paired_sql(where: str = "seed = 42") -> str:
    return f"""pairs AS (SELECT a.dataset, a.task, a.clf, b.method AS reference, a.seed, a.fold, a.f1_macro AS a, b.f1_macro AS b,
      a.n_features AS n_features_a, b.n_features AS n_features_b
      FROM eval_long a JOIN eval_long b ON a.dataset = b.dataset AND a.task = b.task AND a.clf = b.clf AND a.seed = b.seed AND a.fold = b.fold
      WHERE a.method = 'proposed' AND b.method IN ({', '.join(f"'{x}'" for x in REFS)}) AND a.variant = 'main' AND b.variant = 'main'
      AND a.protocol = 'sample_k10' AND b.protocol = 'sample_k10' AND a.clf IN ('rf', 'dt') AND {where.replace('seed', 'a.seed')})"""


def signed_rank_sql(tag: str, diff: str, src: str = "pairs", keys: str = PKS) -> str:
    """CTEs that end in ``tag``(keys, n, w_plus, p_greater, p_less): exact by a recursive convolution."""
    join = f"USING ({keys})"
    q = ", ".join(f"dp.{k.strip()}" for k in keys.split(","))
    on = " AND ".join(f"dp.{k.strip()} = z.{k.strip()}" for k in keys.split(","))
    return f"""{tag}_n AS (SELECT {keys}, count(*) AS n FROM {src} GROUP BY {keys}),
    {tag}_d AS (SELECT {keys}, {diff} AS d FROM {src}),
    {tag}_z AS (SELECT {keys}, d, 2 * rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + count(*) OVER (PARTITION BY {keys}, abs(d)) - 1 AS r2,
      row_number() OVER (PARTITION BY {keys} ORDER BY abs(d), d) AS i, count(*) OVER (PARTITION BY {keys}) AS m FROM {tag}_d WHERE d <> 0),
    {tag}_w AS (SELECT {keys}, max(m) AS m, CAST(sum(CASE WHEN d > 0 THEN r2 ELSE 0 END) AS BIGINT) AS w2 FROM {tag}_z GROUP BY {keys}),
    {tag}_dp AS (SELECT {keys}, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, 1.0e0 AS c FROM {tag}_w UNION ALL
      SELECT {keys}, i, s, sum(c) FROM (SELECT {q}, z.i, dp.s + t.b * z.r2 AS s, dp.c FROM {tag}_dp dp JOIN {tag}_z z ON {on} AND z.i = dp.i + 1, (VALUES (0), (1)) AS t(b)) GROUP BY {keys}, i, s),
    {tag}_t AS (SELECT {keys}, sum(CASE WHEN s >= w2 THEN c ELSE 0 END) / sum(c) AS p_greater, sum(CASE WHEN s <= w2 THEN c ELSE 0 END) / sum(c) AS p_less
      FROM {tag}_dp JOIN {tag}_w {join} WHERE i = m GROUP BY {keys}),
    {tag} AS (SELECT {keys}, n, w2 / 2.0 AS w_plus, CASE WHEN n >= 5 THEN p_greater END AS p_greater, CASE WHEN n >= 5 THEN p_less END AS p_less,
      CASE WHEN n >= 5 AND p_greater IS NOT NULL THEN least(1.0, 2 * least(p_greater, p_less)) END AS p_two_sided FROM {tag}_n LEFT JOIN {tag}_w {join} LEFT JOIN {tag}_t {join})"""


def _pairs(spark, sf, seeds=(42,)):
    ev = fx.eval_long(spark, sf).filter("protocol = 'sample_k10' AND clf IN ('rf', 'dt')")
    return St.paired(ev, "proposed", REFS, ["dataset", "task", "clf"], seeds=list(seeds) if seeds else None)


@query(
    "paired",
    f"WITH {fx.EVAL_LONG}, {paired_sql()} SELECT {PKS}, seed, fold, {r('a')} AS a, {r('b')} AS b, n_features_a, n_features_b FROM pairs",
)
def paired(spark, sf):
    return _pairs(spark, sf)


@query(
    "wilcoxon",
    f"""WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql()}, {signed_rank_sql('w', 'a - b')}
    SELECT {PKS}, n AS n_pairs, {r('w_plus')} AS w_plus, {r('p_two_sided')} AS p_two_sided, {r('p_greater')} AS p_greater, {r('p_less')} AS p_less FROM w""",
)
def wilcoxon(spark, sf):
    return St.wilcoxon(_pairs(spark, sf), PK)


@query(
    "wilcoxon_all_seeds",
    f"""WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql('seed > 0')}, {signed_rank_sql('w', 'a - b')}
    SELECT {PKS}, n AS n_pairs, {r('w_plus')} AS w_plus, {r('p_two_sided')} AS p_two_sided, {r('p_greater')} AS p_greater, {r('p_less')} AS p_less FROM w""",
)
def wilcoxon_all_seeds(spark, sf):
    return St.wilcoxon(_pairs(spark, sf, None), PK)


TOST = f"{signed_rank_sql('lo', 'a - b + 0.01e0')}, {signed_rank_sql('hi', 'a - b + -0.01e0')}, tost AS (SELECT {PKS}, greatest(lo.p_greater, hi.p_less) AS tost_p FROM lo JOIN hi USING ({PKS}))"


@query("tost", f"WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql()}, {TOST} SELECT {PKS}, {r('tost_p')} AS tost_p FROM tost")
def tost(spark, sf):
    return St.tost(_pairs(spark, sf), PK)


def t_sql(src: str = "pairs", keys: str = PKS) -> str:
    """Student t with its tail by Simpson's rule over the density."""
    pdf = "exp(lgamma((n) / 2.0e0) - lgamma((n - 1) / 2.0e0)) / sqrt((n - 1) * pi()) * power(1 + x * x / (n - 1), -n / 2.0e0)"
    return f"""ts AS (SELECT {keys}, count(*) AS n, CASE WHEN stddev_samp(a - b) > 0 THEN avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) END AS t FROM {src} GROUP BY {keys}),
    tq AS (SELECT {keys}, n, t, i, abs(t) * i / 4000.0e0 AS x FROM ts, (SELECT unnest(range(4001)) AS i)),
    tt AS (SELECT {keys}, max(t) AS t, 0.5 - sum(({pdf}) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * abs(max(t)) / 12000.0e0 AS tail FROM tq GROUP BY {keys}),
    tres AS (SELECT {keys}, t, 2 * tail AS t_p_two, CASE WHEN t > 0 THEN tail WHEN t <= 0 THEN 1 - tail END AS t_p_one FROM tt)"""


@query("paired_t", f"WITH {fx.EVAL_LONG}, {paired_sql()}, {t_sql()} SELECT {PKS}, {r('t')} AS t, {r('t_p_two')} AS t_p_two, {r('t_p_one')} AS t_p_one FROM tres")
def paired_t(spark, sf):
    return St.paired_t(_pairs(spark, sf), PK)


def compare_sql(src: str = "pairs", keys: str = PKS, tie: str = "0") -> str:
    return f"""{signed_rank_sql('w', 'a - b', src, keys)}, {signed_rank_sql('lo', 'a - b + 0.01e0', src, keys)}, {signed_rank_sql('hi', 'a - b + -0.01e0', src, keys)}, {t_sql(src, keys)},
    cmp AS (SELECT {keys}, count(*) AS n_pairs, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_diff, stddev_pop(a - b) AS std_diff,
      min(a - b) AS diff_min, max(a - b) AS diff_max, count(*) FILTER (WHERE a - b > {tie}) AS n_positive, count(*) FILTER (WHERE a - b < -{tie}) AS n_negative
      FROM {src} GROUP BY {keys}),
    rec AS (SELECT cmp.*, w.p_two_sided AS wilcoxon_p, w.p_greater AS wilcoxon_p_greater,
      greatest(coalesce(lo.p_greater, CASE WHEN lo.n >= 5 THEN 1 END), coalesce(hi.p_less, CASE WHEN hi.n >= 5 THEN 1 END)) AS tost_p, t, t_p_two, t_p_one
      FROM cmp JOIN w USING ({keys}) JOIN lo USING ({keys}) JOIN hi USING ({keys}) JOIN tres USING ({keys}))"""


REC = ["mean_a", "mean_b", "mean_diff", "std_diff", "diff_min", "diff_max", "wilcoxon_p", "wilcoxon_p_greater", "tost_p", "t", "t_p_two", "t_p_one"]
REC_SQL = f"""n_pairs, n_positive, n_negative, {', '.join(r(c) + ' AS ' + c for c in REC)},
    coalesce(wilcoxon_p_greater < 0.05, false) AS sig_wilcoxon, coalesce(t_p_one < 0.05, false) AS sig_t"""


@query("compare", f"WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql()}, {compare_sql()} SELECT {PKS}, {REC_SQL} FROM rec")
def compare(spark, sf):
    return St.compare(_pairs(spark, sf), PK)


VERDICT = """CASE WHEN wilcoxon_p < 0.05 AND mean_diff > 0 THEN CASE WHEN tost_p < 0.05 THEN 'Superior (equiv.)' ELSE 'Superior' END
    WHEN wilcoxon_p < 0.05 AND mean_diff < 0 THEN CASE WHEN tost_p < 0.05 THEN 'Inferior (equiv.)' ELSE 'Inferior' END
    WHEN tost_p < 0.05 THEN 'Equivalent' ELSE 'Inconclusive' END"""


@query("verdict", f"WITH RECURSIVE {fx.EVAL_LONG}, {paired_sql()}, {compare_sql()} SELECT {PKS}, {VERDICT} AS verdict FROM rec")
def verdict(spark, sf):
    rec = St.compare(_pairs(spark, sf), PK)
    return rec.select(*PK, St.verdict(F.col("mean_diff"), F.col("wilcoxon_p"), F.col("tost_p")).alias("verdict"))
