"""Registered queries: clustering, agreement, neighbour graph, rankings and subset search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from telesift.functions.exprs import feature_stats
from telesift.functions.linalg import vector
from telesift.operators import clusters as Cl
from telesift.operators import eigen as Ei
from telesift.operators import graph as Gr
from telesift.operators import neighbors as N
from telesift.operators import rank as Rk
from telesift.operators import sampling as M
from telesift.operators import scaling as S
from telesift.operators import search as Se
from telesift.plans import fixtures as fx
from telesift.plans.base_queries import FIT_COLS, VAR01, clean_cte, fit_sql, folded, long_sql, nn  # noqa: F401
from telesift.plans.registry import query, r
from telesift.session import cut_lineage, stage

FS = fx.FEATURES
DIST = "list_distance({a}, {b})"
EMB_F = [f"e{i}" for i in range(fx.DIM)]

# ---------------------------------------------------------------- fit and assign


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    centers, cost = Cl.kmeans_fit(fx.emb(spark, sf), 10, n_init=5)
    rows = [(c, i, float(v), cost) for c, row in enumerate(centers) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "cluster int, dim int, center double, cost double")


@query(
    "kmeans_fit_check",
    f"WITH {fx.EMB} SELECT CAST(unnest(range(10)) AS INTEGER) AS cluster, (SELECT count(*) FROM emb) AS n_rows, true AS settled, true AS cost_fits",
)
def kmeans_fit_check(spark, sf):
    """Every centre is the mean of the rows next to it, the clusters share all rows, and the cost is their squared distance."""
    centers, cost = Cl.kmeans_fit(fx.emb(spark, sf), 10, n_init=5)
    rows = stage(Cl.assign(fx.emb(spark, sf), centers), "assigned")
    off = [F.pow(F.avg(F.col("v")[i]) - F.element_at(F.array(*[F.lit(float(c[i])) for c in centers]), F.first("cluster") + 1), 2) for i in range(fx.DIM)]
    square = lambda i: F.pow(F.col("v")[i] - F.element_at(F.array(*[F.lit(float(c[i])) for c in centers]), F.col("cluster") + 1), 2)
    total = rows.agg(F.sum(sum((square(i) for i in range(fx.DIM)), F.lit(0.0))).alias("t"), F.count(F.lit(1)).alias("n")).first()
    settled = rows.groupBy("cluster").agg((F.sqrt(sum(off, F.lit(0.0))) < 1e-4).alias("settled"))
    return settled.select("cluster", F.lit(total["n"]).cast("bigint").alias("n_rows"), "settled", F.lit(abs(total["t"] - cost) <= 1e-6 * cost).alias("cost_fits"))


def _centers(spark, sf) -> np.ndarray:
    """Label means of the embedding table: given centres that SQL can rebuild."""
    rows = fx.emb(spark, sf).groupBy("label").agg(*[F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(fx.DIM)]).orderBy("label").collect()
    return np.array([list(row)[1:] for row in rows])


ASSIGNED = f"""{fx.EMB}, un AS (SELECT label, i, avg(v[i]) AS c FROM emb, (SELECT CAST(unnest(range(1, {fx.DIM + 1})) AS INTEGER) AS i) GROUP BY 1, 2),
    cen AS (SELECT row_number() OVER (ORDER BY label) - 1 AS c, label, list(c ORDER BY i) AS cv FROM un GROUP BY label),
    dist AS (SELECT row_id, emb.label, cen.c, {DIST.format(a='v', b='cv')} AS d FROM emb, cen),
    asg AS (SELECT row_id, any_value(label) AS label, CAST(arg_min(c, (d, c)) AS INTEGER) AS cluster FROM dist GROUP BY 1)"""


@query("assign", f"WITH {ASSIGNED} SELECT row_id, cluster FROM asg")
def assign(spark, sf):
    return Cl.assign(fx.emb(spark, sf), _centers(spark, sf)).select("row_id", "cluster")


@query(
    "relabel_by_size",
    f"""WITH {ASSIGNED}, o AS (SELECT cluster, CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS INTEGER) AS n FROM asg GROUP BY 1)
    SELECT row_id, n AS cluster FROM asg JOIN o USING (cluster)""",
)
def relabel_by_size(spark, sf):
    return Cl.relabel_by_size(Cl.assign(fx.emb(spark, sf), _centers(spark, sf))).select("row_id", "cluster")


@query(
    "cluster_sizes",
    f"""WITH {fx.FLOWS}, c AS (SELECT label_full AS cluster, count(*) AS n FROM flows GROUP BY 1)
    SELECT cluster, n, {r('n / sum(n) OVER ()')} AS share, {r('min(n) OVER () / sum(n) OVER ()')} AS min_share, {r('max(n) OVER () / sum(n) OVER ()')} AS max_share FROM c""",
)
def cluster_sizes(spark, sf):
    return Cl.cluster_sizes(fx.flows(spark, sf).withColumnRenamed("label_full", "cluster"))


# ---------------------------------------------------------------- Silhouette

SIL = f"""{fx.EMB}, sizes AS (SELECT label, count(*) AS n FROM emb GROUP BY 1),
    ds AS (SELECT a.row_id, a.label AS own, b.label AS other, sum({DIST.format(a='a.v', b='b.v')}) AS t FROM emb a, emb b GROUP BY 1, 2, 3),
    ab AS (SELECT ds.row_id, max(CASE WHEN own = other THEN s.n END) AS n, max(CASE WHEN own = other THEN t / greatest(s.n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN t / s.n END) AS b
      FROM ds JOIN sizes s ON s.label = ds.other GROUP BY 1),
    sil AS (SELECT row_id, CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM ab)"""


@query("silhouette", f"WITH {SIL} SELECT {r('avg(s)')} AS silhouette, count(*) AS n_rows FROM sil")
def silhouette(spark, sf):
    return Cl.silhouette(fx.emb(spark, sf), n=2000, label="label")


@query("silhouette_rows", f"WITH {SIL} SELECT row_id, {r('s')} AS s FROM sil")
def silhouette_rows(spark, sf):
    return Cl.silhouette_rows(fx.emb(spark, sf), n=2000, label="label")


@query(
    "silhouette_full",
    f"""WITH {fx.EMB}, sizes AS (SELECT label, count(*) AS n FROM emb GROUP BY 1),
    ds AS (SELECT a.row_id, a.label AS own, b.label AS other, sum(power({DIST.format(a='a.v', b='b.v')}, 2)) AS t FROM emb a, emb b GROUP BY 1, 2, 3),
    ab AS (SELECT ds.row_id, max(CASE WHEN own = other THEN s.n END) AS n, max(CASE WHEN own = other THEN t / greatest(s.n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN t / s.n END) AS b
      FROM ds JOIN sizes s ON s.label = ds.other GROUP BY 1)
    SELECT {r('avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette_sq FROM ab""",
)
def silhouette_full(spark, sf):
    return Cl.silhouette_full(fx.emb(spark, sf), label="label")


PROFILE = f"""{fx.RUN_KEYS}, profile AS (SELECT seed, fold, w.which, k, ((h * (k + 1) + fold * 13 + length(w.which)) % 23) / 40.0e0 AS sil
    FROM run_keys, (SELECT CAST(unnest(range(2, 15)) AS INTEGER) AS k), (VALUES ('full'), ('selected')) AS w(which))"""


def _profile(spark, sf):
    d = fx.run_keys(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(14))))
    d = d.withColumn("which", F.explode(F.array(F.lit("full"), F.lit("selected"))))
    sil = ((F.col("h") * (F.col("k") + 1) + F.col("fold") * 13 + F.length("which")) % 23) / F.lit(40.0)
    return d.select("seed", "fold", "which", "k", sil.alias("sil"))


@query(
    "best_k",
    f"""WITH {PROFILE} SELECT seed, fold, which, k AS k_star, {r('sil')} AS sil FROM
    (SELECT *, row_number() OVER (PARTITION BY seed, fold, which ORDER BY sil DESC, k) AS rn FROM profile) WHERE rn = 1""",
)
def best_k(spark, sf):
    return Cl.best_k(_profile(spark, sf), ["seed", "fold", "which"])


@query("profile_summary", f"WITH {PROFILE} SELECT which, k, {r('avg(sil)')} AS sil_mean, {r('stddev_pop(sil)')} AS sil_std, count(*) AS n FROM profile GROUP BY 1, 2")
def profile_summary(spark, sf):
    return Cl.profile_summary(_profile(spark, sf))


# ---------------------------------------------------------------- agreement

def agreement_sql(cells: str, keys: str) -> str:
    """CTE ``agr`` (keys, ari, ami, nmi) from contingency cells (keys, a, b, n)."""
    return f"""ra AS (SELECT {keys}, a, sum(n) AS na FROM {cells} GROUP BY {keys}, a), cb AS (SELECT {keys}, b, sum(n) AS nb FROM {cells} GROUP BY {keys}, b),
    tt AS (SELECT {keys}, sum(n) AS t, sum(n * (n - 1) / 2.0e0) AS c FROM {cells} GROUP BY {keys}),
    sa AS (SELECT {keys}, sum(na * (na - 1) / 2.0e0) AS sa, -sum(na / t * ln(na / t)) AS ha FROM ra JOIN tt USING ({keys}) GROUP BY {keys}),
    sb AS (SELECT {keys}, sum(nb * (nb - 1) / 2.0e0) AS sb, -sum(nb / t * ln(nb / t)) AS hb FROM cb JOIN tt USING ({keys}) GROUP BY {keys}),
    mi AS (SELECT {keys}, sum(n / t * ln(n * t / (na * nb))) AS mi FROM {cells} JOIN ra USING ({keys}, a) JOIN cb USING ({keys}, b) JOIN tt USING ({keys}) GROUP BY {keys}),
    gr AS (SELECT {keys}, CAST(na AS DOUBLE) AS na, CAST(nb AS DOUBLE) AS nb, CAST(t AS DOUBLE) AS t, unnest(range(CAST(greatest(1, na + nb - t) AS BIGINT), CAST(least(na, nb) AS BIGINT) + 1)) AS x
      FROM ra JOIN cb USING ({keys}) JOIN tt USING ({keys})),
    em AS (SELECT {keys}, sum(x / t * ln(x * t / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1)
      - lgamma(t + 1) - lgamma(CAST(x AS DOUBLE) + 1) - lgamma(na - x + 1) - lgamma(nb - x + 1) - lgamma(t - na - nb + x + 1))) AS emi FROM gr GROUP BY {keys}),
    agr AS (SELECT {keys}, CASE WHEN c = sa AND c = sb THEN 1.0 ELSE (c - sa * sb / (t * (t - 1) / 2.0e0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0e0)) END AS ari,
      (mi - emi) / ((ha + hb) / 2 - emi) AS ami, mi / ((ha + hb) / 2) AS nmi
      FROM tt JOIN sa USING ({keys}) JOIN sb USING ({keys}) JOIN mi USING ({keys}) JOIN em USING ({keys}))"""


FLOW_CELLS = f"{fx.FLOWS}, cells AS (SELECT label2, vol_line AS a, label1 || (vol_qty > 25) AS b, count(*) AS n FROM flows GROUP BY 1, 2, 3)"


def _flow_cells(spark, sf):
    f = fx.flows(spark, sf).withColumn("lab_b", F.concat("label1", (F.col("vol_qty") > 25).cast("string")))
    return Cl.contingency(f, "vol_line", "lab_b", ["label2"])


@query("ari", f"WITH {FLOW_CELLS}, {agreement_sql('cells', 'label2')} SELECT label2, {r('ari')} AS ari FROM agr")
def ari(spark, sf):
    return Cl.ari(_flow_cells(spark, sf), ["label2"])


@query("ami", f"WITH {FLOW_CELLS}, {agreement_sql('cells', 'label2')} SELECT label2, {r('ami')} AS ami FROM agr")
def ami(spark, sf):
    return Cl.ami(_flow_cells(spark, sf), ["label2"])


@query("nmi", f"WITH {FLOW_CELLS}, {agreement_sql('cells', 'label2')} SELECT label2, {r('nmi')} AS nmi FROM agr")
def nmi(spark, sf):
    return Cl.nmi(_flow_cells(spark, sf), ["label2"])


#: The best matching by recursion over the clusters: per set of labels taken (a bit mask) the most rows matched so far.
@query(
    "cluster_accuracy",
    f"""WITH RECURSIVE {ASSIGNED}, lab AS (SELECT label, CAST(c AS INTEGER) AS j FROM cen),
    cells AS (SELECT a.c, b.j, (SELECT count(*) FROM asg JOIN lab USING (label) WHERE asg.cluster = a.c AND lab.j = b.j) AS n FROM cen a, lab b),
    dp AS (SELECT 0 AS i, 0 AS mask, CAST(0 AS BIGINT) AS s UNION ALL SELECT i + 1, mask | (1 << j), CAST(max(s + n) AS BIGINT) FROM dp JOIN cells ON cells.c = dp.i WHERE mask & (1 << j) = 0 GROUP BY 1, 2)
    SELECT {r('max(s) / (SELECT count(*) FROM asg)')} AS accuracy, max(s) AS n_matched, (SELECT count(*) FROM asg) AS n_rows FROM dp""",
)
def cluster_accuracy(spark, sf):
    rows = Cl.assign(fx.emb(spark, sf), _centers(spark, sf))
    return Cl.cluster_accuracy(rows, "cluster", "label")


@query(
    "crosstab",
    f"""WITH {fx.FLOWS} SELECT device_name, {', '.join(f"count(*) FILTER (WHERE label2 = '{c}') AS {chr(34)}{c}{chr(34)}" for c in ('AF', 'AO', 'NF', 'NO', 'RF', 'RO'))} FROM flows GROUP BY 1""",
)
def crosstab(spark, sf):
    return Cl.crosstab(fx.flows(spark, sf), "device_name", "label2")


CROSS = f"""{fx.LABELINGS}, cells AS (SELECT a.pipeline AS p1, b.pipeline AS p2, a.seed AS s1, b.seed AS s2, a.lab AS a, b.lab AS b, count(*) AS n
    FROM labelings a JOIN labelings b ON a.row_id = b.row_id AND a.pipeline < b.pipeline GROUP BY 1, 2, 3, 4, 5, 6),
    {agreement_sql('cells', 'p1, p2, s1, s2')}, ks AS (SELECT pipeline, count(DISTINCT lab) AS k FROM labelings GROUP BY 1),
    cross_pairs AS (SELECT p1, p2, s1 = s2 AS same_seed, x.k = y.k AS same_k, x.k AS k_a, y.k AS k_b, ari, ami FROM agr JOIN ks x ON x.pipeline = p1 JOIN ks y ON y.pipeline = p2)"""


@query("cross_stability", f"WITH {CROSS} SELECT p1, p2, same_seed, same_k, k_a, k_b, {r('ari')} AS ari, {r('ami')} AS ami FROM cross_pairs")
def cross_stability(spark, sf):
    return Cl.cross_stability(fx.labelings(spark, sf))


_SUM = ", ".join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_samp({c})')} AS {c}_std, {r(f'min({c})')} AS {c}_min" for c in ("ari", "ami"))


@query("cross_stability_by_group", f"WITH {CROSS} SELECT same_seed, same_k, {_SUM}, count(*) AS n_pairs FROM cross_pairs GROUP BY 1, 2")
def cross_stability_by_group(spark, sf):
    return Cl.cross_stability_summary(Cl.cross_stability(fx.labelings(spark, sf)))


@query("cross_stability_overall", f"WITH {CROSS} SELECT {_SUM}, count(*) AS n_pairs FROM cross_pairs")
def cross_stability_overall(spark, sf):
    return Cl.cross_stability_summary(Cl.cross_stability(fx.labelings(spark, sf)), [])


@query("resample_stability")
def resample_stability(spark, sf):
    return Cl.agreement_summary(Cl.resample_stability(fx.emb(spark, sf), k=10, b=4))


# ---------------------------------------------------------------- neighbours and graph rankings

KNN = f"""{fx.EMB}, near AS (SELECT * FROM (SELECT a.row_id AS src, b.row_id AS dst, {DIST.format(a='a.v', b='b.v')} AS d,
    row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST.format(a='a.v', b='b.v')}, b.row_id) AS rn FROM emb a JOIN emb b ON a.row_id <> b.row_id) WHERE rn <= 5),
    gw AS (SELECT src, dst, exp(-d * d / power((SELECT avg(d) FROM near), 2)) AS w FROM near),
    edges AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM gw UNION ALL SELECT dst, src, w FROM gw) GROUP BY 1, 2),
    deg AS (SELECT src AS id, sum(w) AS d FROM edges GROUP BY 1)"""


@query("knn_join", f"WITH {KNN} SELECT src AS row_id, dst AS ref_id, {r('d')} AS dist, CAST(rn AS INTEGER) AS rank FROM near")
def knn_join(spark, sf):
    e = fx.emb(spark, sf)
    return N.knn_join(e, e, 5, exclude_self=True)


@query("knn_graph", f"WITH {KNN} SELECT src, dst, {r('w')} AS w FROM edges")
def knn_graph(spark, sf):
    return Gr.knn_graph(fx.emb(spark, sf))


@query(
    "laplacian",
    f"""WITH {KNN} SELECT src, dst, {r('-w')} AS plain, {r('-w / sqrt(a.d * b.d)')} AS normalised FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst
    UNION ALL SELECT id, id, {r('d')}, CASE WHEN d > 0 THEN 1.0e0 ELSE 0.0e0 END FROM deg""",
)
def laplacian(spark, sf):
    return Gr.laplacian(Gr.knn_graph(fx.emb(spark, sf)))


ENDS = f"""pos AS (SELECT CAST(unnest(range({fx.DIM})) AS INTEGER) AS pos),
    ends AS (SELECT pos, w, a.v[pos + 1] AS fa, b.v[pos + 1] AS fb, da.d AS da, db.d AS db FROM edges JOIN emb a ON a.row_id = src JOIN emb b ON b.row_id = dst JOIN deg da ON da.id = src JOIN deg db ON db.id = dst, pos),
    node AS (SELECT pos, v[pos + 1] AS f, d FROM emb JOIN deg ON deg.id = emb.row_id, pos)"""


def _graph(spark, sf):
    e = fx.emb(spark, sf)
    return e, Gr.knn_graph(e)


def ranked_sql(method: str) -> str:
    return f"SELECT '{method}' AS method, CAST(row_number() OVER (ORDER BY score DESC, pos DESC) AS INTEGER) AS rank, pos, 'e' || pos AS feature, {r('score')} AS score FROM s"


@query(
    "rank_laplacian",
    f"""WITH {KNN}, {ENDS}, q AS (SELECT pos, sum(w * (fa - fb) * (fa - fb)) / 2 AS flf FROM ends GROUP BY 1),
    n AS (SELECT pos, sum(d * f * f) - power(sum(d * f), 2) / sum(d) AS den FROM node GROUP BY 1), s AS (SELECT pos, -flf / den AS score FROM q JOIN n USING (pos))
    {ranked_sql('laplacian')}""",
)
def rank_laplacian(spark, sf):
    e, g = _graph(spark, sf)
    return Rk.get_ranker("laplacian", features=EMB_F)(e, g)


@query(
    "rank_spec",
    f"""WITH {KNN}, {ENDS}, q AS (SELECT pos, sum(w * power(fa / sqrt(da) - fb / sqrt(db), 2)) / 2 AS flf FROM ends GROUP BY 1),
    n AS (SELECT pos, sum(f * f) AS den FROM node GROUP BY 1), s AS (SELECT pos, -flf / den AS score FROM q JOIN n USING (pos))
    {ranked_sql('spec')}""",
)
def rank_spec(spark, sf):
    e, g = _graph(spark, sf)
    return Rk.rank_spec(e, g, EMB_F)


@query("rank_udfs")
def rank_udfs(spark, sf):
    e, g = _graph(spark, sf)
    return Rk.rank_udfs(e, g, EMB_F)


@query("rank_ndfs")
def rank_ndfs(spark, sf):
    e, g = _graph(spark, sf)
    return Rk.rank_ndfs(e, g, EMB_F)


@query(
    "smooth_eigenvectors",
    f"""WITH {KNN} SELECT CAST(unnest(range(5)) AS INTEGER) AS vector, (SELECT count(*) FROM deg) AS n_nodes, true AS unit, true AS centred, true AS orthogonal, true AS settled, true AS in_order""",
)
def smooth_eigenvectors(spark, sf):
    """The vectors of the graph against their definition: length, mean, angles and residual, recomputed from the Laplacian."""
    graph = cut_lineage(_graph(spark, sf)[1])
    y = Ei.smooth_eigenvectors(graph, 5)
    ly = Gr.laplacian(graph).join(y.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("plain") * F.col(f"y{i}")).alias(f"l{i}") for i in range(5)])
    both = stage(y.join(ly, "id"), "vectors")
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    value = [dot(f"y{i}", f"l{i}") for i in range(5)]
    # |L y - v y|^2 = |L y|^2 - 2 v y'L y + v^2 cancels; so the values come first
    values = both.agg(*value).first()
    rows = [
        F.struct(
            F.lit(i).alias("vector"), F.count(F.lit(1)).alias("n_nodes"), (F.abs(dot(f"y{i}", f"y{i}") - 1) < 1e-9).alias("unit"), (F.abs(F.avg(f"y{i}")) < 1e-7).alias("centred"),
            F.array_max(F.array(F.lit(0.0), *[F.abs(dot(f"y{i}", f"y{j}")) for j in range(5) if j != i])).__lt__(1e-9).alias("orthogonal"),
            (F.sqrt(F.sum(F.pow(F.col(f"l{i}") - values[i] * F.col(f"y{i}"), 2))) <= 1e-6 * 2 * F.max("deg")).alias("settled"),
            F.lit(i == 0 or values[i] >= values[i - 1] - 1e-9).alias("in_order"),
        )
        for i in range(5)
    ]
    return both.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query("rank_mcfs")
def rank_mcfs(spark, sf):
    e, g = _graph(spark, sf)
    return Rk.rank_mcfs(e, g, EMB_F)


# ---------------------------------------------------------------- simple rankings and sets

VAR_RAW = f"""v AS ({long_sql(f"SELECT {i} AS pos, '{f}' AS feature, var_pop({nn(f)}) AS score FROM flows" for i, f in enumerate(FS))}),
    rk AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, pos DESC) AS INTEGER) AS rank FROM v)"""


@query("rank_variance", f"WITH {fx.FLOWS}, {VAR_RAW} SELECT 'variance' AS method, rank, pos, feature, {r('score', 2)} AS score FROM rk", digits=2)
def rank_variance(spark, sf):
    return Rk.rank_variance(fx.flows(spark, sf), FS)


V01 = f"{clean_cte('flows')}, f AS ({fit_sql('cl')}), v1 AS (SELECT pos, feature, {VAR01} AS score FROM f), r1 AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, pos DESC) AS INTEGER) AS rank FROM v1)"


@query("rank_variance01", f"WITH {fx.FLOWS}, {V01} SELECT 'variance01' AS method, rank, pos, feature, {r('score')} AS score FROM r1")
def rank_variance01(spark, sf):
    return Rk.rank_variance01(S.fit_scaler(fx.flows(spark, sf), FS))


@query("top_k", f"WITH {fx.FLOWS}, {V01} SELECT 'variance01' AS method, rank, pos, feature, {r('score')} AS score FROM r1 WHERE rank <= 4")
def top_k(spark, sf):
    return Rk.top_k(Rk.rank_variance01(S.fit_scaler(fx.flows(spark, sf), FS)), 4)


@query(
    "fixed_set",
    f"""WITH {fx.FLOWS}, n AS ({long_sql(f"SELECT {i} AS pos, '{f}' AS feature, count({f}) AS n FROM flows" for i, f in enumerate(FS))})
    SELECT pos, feature, n FROM n WHERE feature IN ({', '.join(f"'{x}'" for x in fx.REFERENCE_SET)})""",
)
def fixed_set(spark, sf):
    counts = feature_stats(fx.flows(spark, sf), FS, {"n": lambda f: F.count(F.col(f))})
    return Rk.fixed_set(counts, fx.REFERENCE_SET)


@query("get_ranker", f"WITH {fx.FLOWS}, {VAR_RAW} SELECT 'variance' AS method, rank, pos, feature FROM rk")
def get_ranker(spark, sf):
    return Rk.get_ranker("variance", features=FS)(fx.flows(spark, sf)).drop("score")


@query(
    "k_sweep",
    f"""WITH {fx.FLOWS}, {VAR_RAW}, {V01}, a AS (SELECT 'variance' AS method, rank, pos FROM rk UNION ALL SELECT 'variance01', rank, pos FROM r1)
    SELECT method, CAST(b.k AS INTEGER) AS k, count(*) AS n_features, string_agg(pos, ',' ORDER BY pos) AS features FROM a, (VALUES (3), (5), (8)) AS b(k) WHERE rank <= b.k GROUP BY 1, 2""",
)
def k_sweep(spark, sf):
    flows = fx.flows(spark, sf)
    both = Rk.rank_variance(flows, FS).unionByName(Rk.rank_variance01(S.fit_scaler(flows, FS)))
    return Rk.k_sweep(both, [3, 5, 8])


# ---------------------------------------------------------------- subset search

SEARCH_F = FS[:9] + ["edge_missing", "edge_inf"]  # the constant column carries no signal
SEARCH_D = len(SEARCH_F)


def search_table(spark, sf, k: int = 2):
    """Standardised training rows of each fold as (row_id, part, v)."""
    folds = stage(M.stratified_folds(fx.flows(spark, sf), "label2", k).select("row_id", "fold", *SEARCH_F), "folds")
    train = M.train_test(folds, k).filter("role = 'train'")
    stats = S.fit_scaler_training(folds, SEARCH_F, k)
    z = S.apply_scaler(train, stats, SEARCH_F, ["eval_fold"])
    return z.select("row_id", F.col("eval_fold").alias("part"), vector(SEARCH_F).alias("v"))


def _objective(spark, sf, ks=range(2, 15), **kw):
    obj = Se.Objective(search_table(spark, sf), SEARCH_D, **kw)
    obj.choose_k(ks)
    return obj


def _searched(spark, sf, strategy):
    obj = _objective(spark, sf)
    try:
        return Se.history_df(spark, Se.search(obj, strategy))
    finally:
        obj.close()


@query("silhouette_profile")
def silhouette_profile(spark, sf):
    return Se.silhouette_profile(search_table(spark, sf), SEARCH_D, range(2, 15))


@query("score_frontier")
def score_frontier(spark, sf):
    obj = _objective(spark, sf)
    try:
        full = frozenset(range(SEARCH_D))
        scores = obj.frontier([(p, full - {j}) for p in obj.parts for j in range(SEARCH_D)])
    finally:
        obj.close()
    rows = [(p, min(full - s), float(v)) for (p, s), v in scores.items()]
    return spark.createDataFrame(rows, "part int, removed int, j double")


@query("bidirectional_search")
def bidirectional_search(spark, sf):
    return _searched(spark, sf, "alternate")


@query("best_move_search")
def best_move_search(spark, sf):
    return _searched(spark, sf, "best_move")


@query("backward_search")
def backward_search(spark, sf):
    return _searched(spark, sf, "backward")


@query("stepwise_budgets")
def stepwise_budgets(spark, sf):
    obj = _objective(spark, sf)
    try:
        got = Se.stepwise_budgets(obj, {p: list(range(SEARCH_D)) for p in obj.parts}, [9, 10, 11])
    finally:
        obj.close()
    return spark.createDataFrame([(p, b, s) for p, bs in got.items() for b, s in bs.items()], "part int, budget int, subset array<int>")


@query("loo_scores")
def loo_scores(spark, sf):
    obj = _objective(spark, sf)
    try:
        got = Se.loo_scores(obj, {p: list(range(0, SEARCH_D, 2)) for p in obj.parts})
    finally:
        obj.close()
    return spark.createDataFrame([(p, j, float(v)) for p, js in got.items() for j, v in js.items()], "part int, pos int, j double")
