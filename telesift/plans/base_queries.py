"""Registered queries: sources, profiling, scaling, sampling and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from telesift.functions.exprs import feature_stats, filled
from telesift.operators import profile as P
from telesift.operators import sampling as M
from telesift.operators import scaling as S
from telesift.operators.rank import rank_variance01, top_k
from telesift.plans import fixtures as fx
from telesift.plans.registry import query, r
from telesift.session import scratch_path
from telesift.sources import runs as R
from telesift.sources import tables as T
from telesift.table import FeatureTable

FS = fx.FEATURES
CSV_PART = "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"


def sel(cols) -> str:
    return ", ".join(cols)


def nn(c: str) -> str:
    """SQL: missing -> 0, infinite -> NULL."""
    return f"CASE WHEN isinf(coalesce({c}, 0)) THEN NULL ELSE coalesce({c}, 0) END"


def long_sql(parts) -> str:
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- sources


def _csv(spark, df, name):
    return T.save(df, scratch_path(spark, name), "csv")


@query("scan_csv", CSV_PART)
def scan_csv(spark, sf):
    path = _csv(spark, fx.read(spark, sf, "part"), "part-csv")
    df = T.scan_csv(spark, path)
    return df.select(*[F.col(c).cast("bigint") if c in ("p_partkey", "p_size") else F.col(c) for c in df.columns])


@query(
    "scan_pruned",
    f"""SELECT l_returnflag, {sel(r('CAST(' + c + ' AS DOUBLE)') + ' AS ' + c for c in
        ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount'])} FROM lineitem""",
)
def scan_pruned(spark, sf):
    path = _csv(spark, fx.read(spark, sf, "lineitem"), "lineitem-csv")
    return T.scan_pruned(spark, path, deny=["l_tax", "l_linestatus", "l_shipdate"], meta=["l_returnflag"])


@query("materialize", f"WITH {fx.FLOWS} SELECT row_id, label1, {sel(r(c) + ' AS ' + c for c in FS)} FROM flows")
def materialize(spark, sf):
    ft = T.materialize(fx.flow_table(spark, sf), scratch_path(spark, "flows"))
    return ft.df.select("row_id", "label1", *ft.features)


def registry() -> T.DatasetRegistry:
    reg = T.DatasetRegistry()
    reg.add("flows", fx.flow_table)
    reg.add(
        "windows",
        lambda spark, sf: FeatureTable(
            fx.windows(spark, sf).withColumn("row_id", F.concat_ws("|", "user_id", "window_start")),
            fx.WINDOW_FEATURES, "row_id", {}, {"binary": "label1"}, "label1", "windows",
        ),
    )
    reg.add_log_variant("flows_log", "flows")
    return reg


def slog(c: str) -> str:
    return f"sign({c}) * ln(1 + abs({c}))"


@query("load_dataset", f"WITH {fx.FLOWS} SELECT row_id, label2, {sel(r(slog(c)) + ' AS ' + c for c in FS)} FROM flows")
def load_dataset(spark, sf):
    ft = registry().load("flows_log", spark, sf)
    return ft.df.select("row_id", "label2", *ft.features)


@query(
    "groups_from_prefix",
    f"""WITH {fx.FLOWS}, d AS ({long_sql(f"SELECT {i} AS pos, '{f}' AS feature, count({f}) AS n FROM flows" for i, f in enumerate(FS))})
    SELECT split_part(feature, '_', 1) AS "group", count(*) AS n_features, string_agg(feature, ',' ORDER BY pos) AS members
    FROM d WHERE n > 0 GROUP BY 1""",
)
def groups_from_prefix(spark, sf):
    counts = feature_stats(fx.flows(spark, sf), FS, {"n": lambda f: F.count(F.col(f))})
    return T.groups_from_prefix(counts.filter("n > 0"))


def _run_tree(spark, sf):
    ev = fx.eval_long(spark, sf)
    done = ev.select(*R.RUN_KEYS).distinct().filter("NOT (seed = 43 AND fold = 1)")
    return R.write_runs(ev, scratch_path(spark, "runs"), done)


@query(
    "scan_runs",
    f"""WITH {fx.EVAL_LONG} SELECT DISTINCT dataset, protocol, seed, fold, variant FROM eval_long
    WHERE dataset = 'flows' AND protocol = 'sample_k10' AND variant = 'main' AND NOT (seed = 43 AND fold = 1)""",
)
def scan_runs(spark, sf):
    root = _run_tree(spark, sf)
    return R.scan_runs(spark, root, "eval.json", "flows", "sample_k10", "main", require_done=True).drop("value")


@query(
    "eval_long",
    f"""WITH {fx.EVAL_LONG} SELECT dataset, protocol, seed, fold, variant, method, n_features, task, clf,
    {sel(r(m) + ' AS ' + m for m in R.METRICS)} FROM eval_long""",
)
def eval_long(spark, sf):
    return R.eval_long(R.scan_runs(spark, _run_tree(spark, sf), "eval.json"))


@query(
    "resolve_names",
    f"""WITH {fx.SELECTIONS}, {fx.FEATURE_DIM}, named AS (
      SELECT run_id, feature FROM selections JOIN feature_dim USING (pos) UNION ALL
      SELECT DISTINCT run_id, 'gone_feature' FROM selections)
    SELECT run_id, feature, pos FROM named JOIN feature_dim USING (feature)""",
)
def resolve_names(spark, sf):
    dim = fx.feature_dim(spark)
    stored = fx.selections(spark, sf).join(dim, "pos").groupBy("run_id").agg(
        F.concat(F.collect_list("feature"), F.array(F.lit("gone_feature"))).alias("names")
    )
    return T.resolve_names(stored, dim)


@query(
    "union_results",
    f"""WITH {fx.EVAL_LONG} SELECT seed, fold, method, task, clf, {r('f1_macro')} AS f1_macro,
    CASE WHEN protocol = 'sample_k10' THEN {r('mcc')} END AS mcc
    FROM eval_long WHERE dataset = 'flows' AND variant = 'main'""",
)
def union_results(spark, sf):
    ev = fx.eval_long(spark, sf).filter("dataset = 'flows' AND variant = 'main'")
    keys = ["seed", "fold", "method", "task", "clf"]
    a = _csv(spark, ev.filter("protocol = 'sample_k10'").select(*keys, "f1_macro", "mcc"), "res-a")
    b = _csv(spark, ev.filter("protocol <> 'sample_k10'").select(*keys, "f1_macro"), "res-b")
    return T.union_results(spark, [a, b])


@query(
    "save",
    f"""WITH {fx.SELECTIONS} SELECT run_id, seed, fold, pos, k_star FROM selections""",
)
def save(spark, sf):
    path = T.save(fx.selections(spark, sf), scratch_path(spark, "selections"), "json", ["seed"])
    return spark.read.schema("run_id int, fold int, pos int, k_star int, seed int").json(path)


# ---------------------------------------------------------------- profile


@query(
    "select_features",
    "SELECT o_orderkey, " + r("o_totalprice") + " AS o_totalprice FROM orders",
)
def select_features(spark, sf):
    return P.select_features(fx.read(spark, sf, "orders"), deny=["o_custkey"], keep=["o_orderkey"])


@query(
    "column_presence",
    """SELECT 'l_tax' AS "column", true AS found, count(l_tax) AS n_values FROM lineitem UNION ALL
    SELECT 'l_shipdate', true, count(l_shipdate) FROM lineitem UNION ALL SELECT 'l_missing', false, 0""",
)
def column_presence(spark, sf):
    return P.column_presence(fx.read(spark, sf, "lineitem"), ["l_tax", "l_shipdate", "l_missing"])


@query(
    "type_census",
    """SELECT 'numeric' AS kind, CAST(8 AS BIGINT) AS n_columns,
    CAST(sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_usable FROM (
      SELECT unnest([count(l_partkey), count(l_suppkey), count(l_linenumber), count(l_quantity),
                     count(l_extendedprice), count(l_discount), count(l_tax)]) AS c FROM lineitem)
    UNION ALL SELECT 'string', 2, 0 UNION ALL SELECT 'other', 1, 0""",
)
def type_census(spark, sf):
    return P.type_census(fx.read(spark, sf, "lineitem"), deny=["l_orderkey"])


@query(
    "label_distribution",
    f"""WITH {fx.FLOWS}, long AS ({long_sql(f"SELECT '{c}' AS label, {c} AS value FROM flows" for c in ("label1", "label2", "label_full"))}),
    c AS (SELECT label, value, count(*) AS n FROM long GROUP BY 1, 2),
    k AS (SELECT *, sum(n) OVER (PARTITION BY label) AS t, count(*) OVER (PARTITION BY label) AS n_classes,
          row_number() OVER (PARTITION BY label ORDER BY n DESC, value) AS rk FROM c)
    SELECT label, value, n, {r('n * 100.0e0 / t')} AS percent, CAST(rk AS INTEGER) AS rank, n_classes FROM k WHERE rk <= 10""",
)
def label_distribution(spark, sf):
    return P.label_distribution(fx.flows(spark, sf), ["label1", "label2", "label_full"])


@query("distinct_entities", f"WITH {fx.FLOWS} SELECT count(DISTINCT device_name) AS n_entities FROM flows")
def distinct_entities(spark, sf):
    return P.distinct_entities(fx.flows(spark, sf), "device_name")


@query(
    "quality_counts",
    f"""WITH {fx.FLOWS}, d AS ({long_sql(f"SELECT {i} AS pos, '{f}' AS feature, count(*) - count({f}) AS n_missing, count(*) FILTER (WHERE isinf({f})) AS n_infinite FROM flows" for i, f in enumerate(FS))})
    SELECT feature, n_missing, n_infinite, CAST(sum(n_missing) OVER () AS BIGINT) AS total_missing,
    CAST(sum(n_infinite) OVER () AS BIGINT) AS total_infinite,
    CAST(row_number() OVER (ORDER BY n_missing + n_infinite DESC, pos) AS INTEGER) AS rank FROM d""",
)
def quality_counts(spark, sf):
    return P.quality_counts(fx.flows(spark, sf), FS)


@query(
    "zero_variance",
    f"""WITH {fx.FLOWS}, d AS ({long_sql(f"SELECT {i} AS pos, '{f}' AS feature, stddev_samp({f}) AS sd, min({f}) AS constant FROM flows" for i, f in enumerate(FS) if f != 'edge_inf')})
    SELECT pos, feature, {r('constant')} AS constant FROM d WHERE sd = 0""",
)
def zero_variance(spark, sf):
    return P.zero_variance(fx.flows(spark, sf), FS)


def _mapped(spark, sf):
    groups = {"Volume": ["vol_qty", "vol_line", "vol_gone"], "Price": fx.GROUPS["Price"], "Rate": fx.GROUPS["Rate"]}
    return FeatureTable(fx.flows(spark, sf), FS, groups=groups)


@query(
    "group_mapping",
    f"""WITH {fx.FLOWS}, n AS ({long_sql(f"SELECT '{f}' AS feature, count({f}) AS n_values FROM flows" for f in FS)}),
    g(grp, feature) AS (VALUES ('Volume','vol_qty'),('Volume','vol_line'),('Volume','vol_gone'),
      {sel(f"('{g}','{f}')" for g in ('Price', 'Rate') for f in fx.GROUPS[g])})
    SELECT coalesce(grp, '(unmapped)') AS "group", count(*) AS n_declared, count(n_values) AS n_found,
    CAST(coalesce(sum(n_values), 0) AS BIGINT) AS n_values FROM g FULL JOIN n USING (feature) GROUP BY 1""",
)
def group_mapping(spark, sf):
    return P.group_mapping(_mapped(spark, sf))


@query(
    "group_index",
    f"""WITH {fx.FLOWS}, n AS ({long_sql(f"SELECT {i} AS pos, '{f}' AS feature, {next(gi for gi, g in enumerate(fx.GROUPS) if f in fx.GROUPS[g])} AS group_id, count({f}) AS n_values FROM flows" for i, f in enumerate(FS))})
    SELECT pos, feature, group_id, n_values FROM n""",
)
def group_index(spark, sf):
    return P.group_index(fx.flow_table(spark, sf))


@query(
    "dataset_summary",
    f"""WITH {fx.FLOWS} SELECT count(*) AS n_rows, 12 AS n_features, count(DISTINCT label2) AS n_classes,
    count(DISTINCT device_name) AS n_entities, {' + '.join(f'(count(*) - count({f}))' for f in FS)} AS n_missing,
    count(*) FILTER (WHERE isinf(edge_inf)) AS n_infinite,
    CAST({' + '.join(f'CASE WHEN stddev_samp({f}) = 0 THEN 1 ELSE 0 END' for f in FS if f != 'edge_inf')} AS BIGINT) AS n_constant
    FROM flows""",
)
def dataset_summary(spark, sf):
    return P.dataset_summary(fx.flows(spark, sf), FS, "label2", "device_name")


@query("idle_rows", f"""WITH {fx.WINDOWS} SELECT user_id, window_start, n_all FROM windows
    WHERE n_view = 0 AND n_click = 0 AND n_error = 0""")
def idle_rows(spark, sf):
    return P.idle_rows(fx.windows(spark, sf), ["n_view", "n_click", "n_error"]).select("user_id", "window_start", "n_all")


@query("signed_log", f"WITH {fx.WINDOWS} SELECT user_id, window_start, {sel(r(slog(c)) + ' AS ' + c for c in fx.WINDOW_FEATURES)} FROM windows")
def signed_log(spark, sf):
    out = P.signed_log_features(fx.windows(spark, sf), fx.WINDOW_FEATURES)
    return out.select("user_id", "window_start", *fx.WINDOW_FEATURES)


@query(
    "mask_features",
    f"WITH {fx.FLOWS} SELECT row_id, {sel((r(f) if i in (0, 2, 5) else '0.0e0') + ' AS ' + f for i, f in enumerate(FS))} FROM flows",
)
def mask_features(spark, sf):
    return P.mask_features(fx.flows(spark, sf).select("row_id", *FS), FS, [0, 2, 5])


@query("derive_labels", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'attack' ELSE 'normal' END AS label1 FROM events")
def derive_labels(spark, sf):
    ev = fx.read(spark, sf, "events")
    return P.derive_labels(ev, F.col("event_type") == "error").select("event_id", "label1")


@query(
    "short_name",
    """SELECT p_type, replace(replace('network_' || p_name || '_std_deviation', 'network_', ''), '_std_deviation', '_std') AS short,
    count(*) AS n FROM part GROUP BY 1, 2""",
)
def short_name(spark, sf):
    named = F.concat(F.lit("network_"), F.col("p_name"), F.lit("_std_deviation"))
    return fx.read(spark, sf, "part").groupBy("p_type", P.short_name(named).alias("short")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "base_method",
    f"""WITH {fx.EVAL_LONG} SELECT regexp_replace(method, '_k?\\d+$', '') AS base, count(*) AS n FROM eval_long GROUP BY 1""",
)
def base_method(spark, sf):
    return fx.eval_long(spark, sf).groupBy(P.base_method(F.col("method")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "encode_labels",
    f"""WITH {fx.FLOWS} SELECT row_id, label2, CAST(dense_rank() OVER (ORDER BY label2) - 1 AS INTEGER) AS label2_idx FROM flows""",
)
def encode_labels(spark, sf):
    return P.encode_labels(fx.flows(spark, sf), "label2").select("row_id", "label2", "label2_idx")


# ---------------------------------------------------------------- scaling


def clean_cte(src: str, by: str = "") -> str:
    """CTEs m (fill values) and cl (cleaned rows) over ``src``."""
    over = f"(PARTITION BY {by})" if by else "()"
    fill = sel(
        f"CASE WHEN isinf(coalesce({f}, 0)) THEN coalesce(max({nn(f)}) OVER {over}, 0) ELSE coalesce({f}, 0) END AS {f}"
        for f in FS
    )
    keep = f"{by}, " if by else ""
    return f"cl AS (SELECT {keep}row_id, {fill} FROM {src})"


def fit_sql(src: str, by: str = "") -> str:
    g = f" GROUP BY {by}" if by else ""
    b = f"{by}, " if by else ""
    return long_sql(
        f"""SELECT {b}{i} AS pos, '{f}' AS feature, max({f}) AS raw_max, avg({f}) AS mean, stddev_pop({f}) AS raw_std,
        min({f}) AS raw_min FROM {src}{g}"""
        for i, f in enumerate(FS)
    )


FIT_COLS = f"""{r('raw_max')} AS fmax, {r('mean')} AS mean, {r('CASE WHEN raw_std > 0 THEN raw_std ELSE 1 END')} AS std,
    {r('raw_std')} AS raw_std, {r('raw_min')} AS raw_min, {r('raw_max')} AS raw_max"""


@query("fit_scaler", f"WITH {fx.FLOWS}, {clean_cte('flows', 'label2')}, f AS ({fit_sql('cl', 'label2')}) SELECT label2, pos, feature, {FIT_COLS} FROM f")
def fit_scaler(spark, sf):
    return S.fit_scaler(fx.flows(spark, sf), FS, ["label2"])


def folded(k: int, by: str = "label2", src: str = "flows") -> str:
    return f"""folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY {by} ORDER BY md5('42|' || row_id), row_id) - 1) % {k} AS INTEGER) AS fold FROM {src})"""


def expanded(k: int) -> str:
    return f"""ex AS (SELECT folded.*, CAST(e.f AS INTEGER) AS eval_fold FROM folded, (SELECT unnest(range({k})) AS f) e WHERE folded.fold <> e.f)"""


@query(
    "fit_scaler_training",
    f"""WITH {fx.FLOWS}, {folded(5)}, {expanded(5)}, {clean_cte('ex', 'eval_fold')}, f AS ({fit_sql('cl', 'eval_fold')})
    SELECT eval_fold, pos, feature, {FIT_COLS} FROM f""",
)
def fit_scaler_training(spark, sf):
    return S.fit_scaler_training(M.stratified_folds(fx.flows(spark, sf), "label2", 5), FS, 5)


def z(f: str, over: str = "()") -> str:
    return f"({f} - avg({f}) OVER {over}) / CASE WHEN stddev_pop({f}) OVER {over} > 0 THEN stddev_pop({f}) OVER {over} ELSE 1 END"


@query("apply_scaler", f"WITH {fx.FLOWS}, {clean_cte('flows')} SELECT row_id, {sel(r(z(f), 5) + ' AS ' + f for f in FS)} FROM cl", digits=5)
def apply_scaler(spark, sf):
    flows = fx.flows(spark, sf).select("row_id", *FS)
    return S.apply_scaler(flows, S.fit_scaler(flows, FS), FS)


@query(
    "apply_scaler_grouped",
    f"""WITH {fx.FLOWS}, {clean_cte('flows', 'label2')} SELECT row_id, label2, {sel(r(z(f, '(PARTITION BY label2)'), 5) + ' AS ' + f for f in FS)} FROM cl""",
    digits=5,
)
def apply_scaler_grouped(spark, sf):
    flows = fx.flows(spark, sf).select("row_id", "label2", *FS)
    return S.apply_scaler(flows, S.fit_scaler(flows, FS, ["label2"]), FS, ["label2"])


@query(
    "clean_and_scale",
    f"WITH {fx.FLOWS}, {clean_cte('flows')} SELECT row_id, {sel(r(z(f), 5) + ' AS ' + f for f in FS if f != 'edge_const')} FROM cl",
    digits=5,
)
def clean_and_scale(spark, sf):
    return S.clean_and_scale(fx.flows(spark, sf), fx.DENY, ["row_id"])[0]


VAR01 = "power(raw_std / CASE WHEN raw_max > raw_min THEN raw_max - raw_min ELSE 1 END, 2)"


@query("minmax_variance", f"WITH {fx.FLOWS}, {clean_cte('flows')}, f AS ({fit_sql('cl')}) SELECT pos, feature, {r(VAR01)} AS var01 FROM f")
def minmax_variance(spark, sf):
    return S.minmax_variance(S.fit_scaler(fx.flows(spark, sf), FS))


@query(
    "flagship_top_features",
    f"""WITH {fx.FLOWS}, {folded(5)}, {expanded(5)}, {clean_cte('ex', 'eval_fold')}, f AS ({fit_sql('cl', 'eval_fold')}),
    v AS (SELECT eval_fold, pos, feature, {VAR01} AS score FROM f),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY eval_fold ORDER BY score DESC, pos DESC) AS INTEGER) AS rank FROM v)
    SELECT eval_fold, rank, pos, feature, {r('score')} AS score FROM k WHERE rank <= 5""",
)
def flagship_top_features(spark, sf):
    """Top five features by min-max variance, per training fold, from one pass over the rows."""
    folds = M.stratified_folds(fx.flows(spark, sf), "label2", 5)
    stats = S.fit_scaler_training(folds, FS, 5)
    return top_k(rank_variance01(stats, by=["eval_fold"]), 5, by=["eval_fold"]).drop("method")


# ---------------------------------------------------------------- sampling and folds

H = "md5('42|' || row_id), row_id"


@query("sample_n", f"WITH {fx.FLOWS} SELECT row_id, label2 FROM (SELECT *, row_number() OVER (ORDER BY {H}) AS rn FROM flows) WHERE rn <= 5000")
def sample_n(spark, sf):
    return M.sample_n(fx.flows(spark, sf), n=5000).select("row_id", "label2")


@query(
    "sample_frac",
    f"""WITH {fx.FLOWS} SELECT row_id, label2 FROM (SELECT *, row_number() OVER (ORDER BY {H}) AS rn, count(*) OVER () AS n FROM flows)
    WHERE rn <= round_even(n * 0.25e0, 0)""",
)
def sample_frac(spark, sf):
    return M.sample_n(fx.flows(spark, sf), frac=0.25).select("row_id", "label2")


def usql(*parts) -> str:
    """SQL twin of the hash uniform."""
    text = " || '|' || ".join(str(p) if not str(p).isdigit() else f"'{p}'" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0e0)"


@query("sample_p", f"WITH {fx.FLOWS} SELECT row_id, label1 FROM flows WHERE {usql(42, 'row_id')} < 0.035e0")
def sample_p(spark, sf):
    return M.sample_p(fx.flows(spark, sf), 0.035).select("row_id", "label1")


@query(
    "sample_stratified",
    f"""WITH {fx.FLOWS}, c AS (SELECT label_full, count(*) AS c, sum(count(*)) OVER () AS t FROM flows GROUP BY 1),
    a AS (SELECT *, greatest(1, floor(c / t * 3000)) AS a FROM c),
    q AS (SELECT label_full, a + CASE WHEN row_number() OVER (ORDER BY c DESC, label_full) = 1 THEN 3000 - sum(a) OVER () ELSE 0 END AS q FROM a)
    SELECT row_id, label_full FROM (SELECT row_id, label_full, row_number() OVER (PARTITION BY label_full ORDER BY {H}) AS rn FROM flows)
    JOIN q USING (label_full) WHERE rn <= q""",
)
def sample_stratified(spark, sf):
    return M.sample_stratified(fx.flows(spark, sf), "label_full", 3000).select("row_id", "label_full")


def ranked(by: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {H}) AS rn, count(*) OVER (PARTITION BY {by}) AS gs FROM flows)"


@query("sample_per_group", f"WITH {fx.FLOWS} SELECT row_id, label2 FROM {ranked('label2')} WHERE rn <= 833")
def sample_per_group(spark, sf):
    return M.sample_per_group(fx.flows(spark, sf), "label2", 5000 // 6).select("row_id", "label2")


@query(
    "balanced_split",
    f"""WITH {fx.FLOWS} SELECT row_id, label_full, CASE WHEN rn <= greatest(1, least(300, floor(gs * 0.7e0))) THEN 'train' ELSE 'holdout' END AS role
    FROM {ranked('label_full')}""",
)
def balanced_split(spark, sf):
    return M.balanced_split(fx.flows(spark, sf), "label_full", 300).select("row_id", "label_full", "role")


@query(
    "split_by_group",
    f"""WITH {fx.FLOWS} SELECT row_id, label2, CASE WHEN rn <= round_even(gs * 0.7e0, 0) THEN 'train' ELSE 'holdout' END AS role FROM {ranked('label2')}""",
)
def split_by_group(spark, sf):
    return M.split_by_group(fx.flows(spark, sf), "label2").select("row_id", "label2", "role")


@query("stratified_folds", f"WITH {fx.FLOWS}, {folded(10)} SELECT row_id, label2, fold FROM folded")
def stratified_folds(spark, sf):
    return M.stratified_folds(fx.flows(spark, sf), "label2", 10).select("row_id", "label2", "fold")


DAY = 86_400
BLOCK = "CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / ({s} * 1000000.0e0)) AS BIGINT)"
EXEC = f"CASE WHEN label1 = 'benign' THEN 'benign_block_' || CAST({BLOCK.format(s=DAY)} AS VARCHAR) ELSE label_full END"


@query("group_exec", f"WITH {fx.FLOWS} SELECT row_id, {EXEC} AS grp FROM flows")
def group_exec(spark, sf):
    return M.group_exec(fx.flows(spark, sf), seconds=DAY).select("row_id", "grp")


@query("group_device", f"WITH {fx.FLOWS} SELECT row_id, device_name AS grp FROM flows")
def group_device(spark, sf):
    return M.group_device(fx.flows(spark, sf)).select("row_id", "grp")


@query("group_time", f"SELECT event_id, CAST({BLOCK.format(s=300)} AS VARCHAR) AS grp FROM events")
def group_time(spark, sf):
    return M.group_time(fx.read(spark, sf, "events")).select("event_id", "grp")


#: The deal as a recursion over the groups, largest share vector first; state: class counts and rows of the five folds.
GROUP_FOLDS = f"""grouped AS (SELECT *, {EXEC} AS grp FROM flows),
    cells AS (SELECT grp, label2, count(*) AS c FROM grouped GROUP BY 1, 2),
    cls AS (SELECT label2, CAST(t AS DOUBLE) AS t, CAST(floor(1000 * (max(t) OVER () / t) * (max(t) OVER () / t)) AS HUGEINT) AS w FROM (SELECT label2, sum(c) AS t FROM cells GROUP BY 1)),
    filled AS (SELECT g.grp, cls.label2, cls.t, cls.w, coalesce(c, 0) AS c FROM (SELECT DISTINCT grp FROM cells) g CROSS JOIN cls LEFT JOIN cells USING (grp, label2)),
    gv AS (SELECT grp, list(CAST(c AS HUGEINT) ORDER BY label2) AS n, list(c * w ORDER BY label2) AS wn, CAST(sum(c) AS HUGEINT) AS s, sum(c * c / (t * t)) AS size FROM filled GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY round(size, 12) DESC, md5('42|' || grp), grp) AS i FROM gv),
    deal AS (SELECT 0 AS i, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS BIGINT) AS f, [[CAST(0 AS HUGEINT) FOR x IN range(len(n))] FOR y IN range(5)] AS loads, [CAST(0 AS HUGEINT) FOR y IN range(5)] AS rows FROM o WHERE i = 1
      UNION ALL SELECT i, grp, f, [CASE WHEN y + 1 = f THEN [loads[f][x] + n[x] FOR x IN range(1, len(n) + 1)] ELSE loads[y + 1] END FOR y IN range(5)], [CASE WHEN y + 1 = f THEN rows[f] + s ELSE rows[y + 1] END FOR y IN range(5)]
      FROM (SELECT i, grp, n, s, loads, rows, list_position(k, list_min(k)) AS f FROM (SELECT o.*, deal.loads, deal.rows, [CAST(list_sum([loads[y + 1][x] * o.wn[x] FOR x IN range(1, len(o.wn) + 1)]) AS HUGEINT) * 1000000000 + rows[y + 1] FOR y IN range(5)] AS k FROM deal JOIN o ON o.i = deal.i + 1))),
    gf AS (SELECT grp, CAST(f - 1 AS INTEGER) AS fold FROM deal WHERE i > 0)"""


@query("stratified_group_folds", f"WITH RECURSIVE {fx.FLOWS}, {GROUP_FOLDS} SELECT row_id, grp, fold FROM grouped JOIN gf USING (grp)")
def stratified_group_folds(spark, sf):
    grouped = M.group_exec(fx.flows(spark, sf), seconds=DAY)
    return M.stratified_group_folds(grouped, "label2", "grp", 5).select("row_id", "grp", "fold")


@query("full_fold", f"WITH {fx.FLOWS} SELECT row_id, 0 AS fold, 'train' AS role FROM flows")
def full_fold(spark, sf):
    return M.full_fold(fx.flows(spark, sf)).select("row_id", "fold", "role")


@query(
    "train_test",
    f"""WITH {fx.FLOWS}, {folded(5)} SELECT CAST(e.f AS INTEGER) AS eval_fold, CASE WHEN fold = e.f THEN 'test' ELSE 'train' END AS role,
    label2, count(*) AS n FROM folded, (SELECT unnest(range(5)) AS f) e GROUP BY 1, 2, 3""",
)
def train_test(spark, sf):
    folds = M.stratified_folds(fx.flows(spark, sf), "label2", 5)
    return M.train_test(folds, 5).groupBy("eval_fold", "role", "label2").agg(F.count(F.lit(1)).alias("n"))


DUP_FEATURES = ["n_view", "n_click", "n_error"]


@query(
    "duplicate_overlap",
    f"""WITH {fx.WINDOWS}, keyed AS (SELECT *, CAST(user_id AS VARCHAR) || '|' || strftime(window_start, '%Y-%m-%d') AS row_id FROM windows),
    {folded(5, 'label1', 'keyed')},
    d AS (SELECT *, 'dev_' || CAST(user_id % 7 AS VARCHAR) AS dev FROM folded),
    p AS (SELECT 'sample_k5' AS protocol, fold, {sel(DUP_FEATURES)} FROM d UNION ALL
          SELECT 'device', CAST(user_id % 7 AS INTEGER), {sel(DUP_FEATURES)} FROM d),
    t AS (SELECT protocol, fold, n_view = 0 AND n_click = 0 AND n_error = 0 AS idle,
          count(*) OVER (PARTITION BY protocol, {sel(DUP_FEATURES)}) > count(*) OVER (PARTITION BY protocol, fold, {sel(DUP_FEATURES)}) AS dup FROM p
          UNION ALL SELECT 'whole table', NULL, n_view = 0 AND n_click = 0 AND n_error = 0, count(*) OVER (PARTITION BY {sel(DUP_FEATURES)}) > 1 FROM d),
    s AS (SELECT protocol, fold, avg(CASE WHEN dup THEN 1.0e0 ELSE 0 END) AS dup, avg(CASE WHEN dup AND NOT idle THEN 1.0e0 ELSE 0 END) AS nonidle,
          avg(CASE WHEN idle THEN 1.0e0 ELSE 0 END) AS idle FROM t GROUP BY 1, 2)
    SELECT protocol, {r('avg(dup)')} AS dup_share_mean, {r('min(dup)')} AS dup_share_min, {r('max(dup)')} AS dup_share_max,
    {r('avg(nonidle)')} AS nonidle_dup_share_mean, {r('max(nonidle)')} AS nonidle_dup_share_max, {r('avg(idle)')} AS idle_share FROM s GROUP BY 1""",
)
def duplicate_overlap(spark, sf):
    keyed = fx.windows(spark, sf).withColumn(
        "row_id", F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("window_start", "yyyy-MM-dd"))
    )
    folds = M.stratified_folds(keyed, "label1", 5).withColumn("dev", (F.col("user_id") % 7).cast("int"))
    return M.duplicate_overlap(folds, DUP_FEATURES, {"sample_k5": "fold", "device": "dev"})
