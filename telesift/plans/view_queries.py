"""Registered queries: augmented views, encoders and representation checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from telesift.functions.linalg import vector
from telesift.operators import scaling as S
from telesift.operators import views as V
from telesift.plans import fixtures as fx
from telesift.plans.base_queries import clean_cte, sel, z
from telesift.plans.registry import query, r
from telesift.plans.stat_queries import D  # noqa: F401

FS = fx.FEATURES
EF = [f"e{i}" for i in range(fx.DIM)]


def part(*parts) -> str:
    return " || '|' || ".join(f"'{p[1:]}'" if str(p).startswith("=") else str(p) for p in parts)


def h(*parts) -> str:
    return f"md5('42|' || {part(*parts)})"


def u(*parts) -> str:
    return f"(CAST('0x' || substr({h(*parts)}, 1, 13) AS BIGINT) / 4503599627370496.0e0)"


def gauss(*parts) -> str:
    return f"(sqrt(-2 * ln(1 - {u(*parts, '=u')})) * cos(6.283185307179586e0 * {u(*parts, '=v')}))"


Z = f"""{fx.FLOWS}, {clean_cte('flows')}, zs AS (SELECT row_id, {sel(z(f) + ' AS ' + f for f in FS)} FROM cl),
    vw AS (SELECT zs.*, t.view FROM zs, (VALUES ('a'), ('b')) AS t(view))"""
G = list(fx.GROUPS)
MASKED = f"""dr AS (SELECT *, floor({u('row_id', 'view', '=m')} * 3) AS m, list_sort([{', '.join(h('row_id', 'view', '=' + g) for g in G)}]) AS dg FROM {{src}}),
    mk AS (SELECT *, {', '.join(f"list_position(dg, {h('row_id', 'view', '=' + g)}) <= m AS mask_{g}" for g in G)} FROM dr)"""
OWNER = {f: g for g, fs in fx.GROUPS.items() for f in fs}


def _scaled(spark, sf):
    stats = S.fit_scaler(fx.flows(spark, sf), FS)
    return S.apply_scaler(fx.flows(spark, sf, spread=True).select("row_id", *FS), stats, FS)


def cells(fn, digits=5) -> str:
    return sel(f"{r(fn(f), digits)} AS {f}" for f in FS)


@query("group_mask", f"WITH {Z}, {MASKED.format(src='vw')} SELECT row_id, view, {cells(lambda f: f'CASE WHEN mask_{OWNER[f]} THEN 0 ELSE {f} END')} FROM mk", digits=5)
def group_mask(spark, sf):
    return V.group_mask(V.expand_views(_scaled(spark, sf)), FS, fx.GROUPS)


def _ind(f: str) -> str:
    return f"CASE WHEN {u('row_id', 'view', '=' + f, '=i')} >= 0.25e0 THEN {f} ELSE 0 END"


@query("independent_mask", f"WITH {Z} SELECT row_id, view, {cells(_ind)} FROM vw", digits=5)
def independent_mask(spark, sf):
    return V.independent_mask(V.expand_views(_scaled(spark, sf)), FS, len(G))


def _drop(f: str) -> str:
    return f"CASE WHEN {u('row_id', 'view', '=' + f, '=d')} >= 0.1e0 THEN {f} ELSE 0 END"


@query("feature_dropout", f"WITH {Z} SELECT row_id, view, {cells(_drop)} FROM vw", digits=5)
def feature_dropout(spark, sf):
    return V.feature_dropout(V.expand_views(_scaled(spark, sf)), FS)


def _noise(f: str) -> str:
    return f"({f} + 0.05e0 * {gauss('row_id', 'view', '=' + f)})"


@query("noise", f"WITH {Z} SELECT row_id, view, {cells(_noise)} FROM vw", digits=5)
def noise(spark, sf):
    return V.noise(V.expand_views(_scaled(spark, sf)), FS)


@query(
    "noise_relative",
    f"""WITH {Z} SELECT row_id, view, {cells(lambda f: f"{f} + 0.05e0 * {gauss('row_id', 'view', '=' + f)} * (stddev_pop({f}) OVER () + 1e-8)")} FROM vw""",
    digits=5,
)
def noise_relative(spark, sf):
    return V.noise(V.expand_views(_scaled(spark, sf)), FS, relative=True)


_AUG = f"au AS (SELECT row_id, view, {sel(_drop(f).replace(f'THEN {f}', f'THEN {_noise(f)}') + ' AS ' + f for f in FS)} FROM vw)"


@query(
    "two_views",
    f"WITH {Z}, {_AUG}, {MASKED.format(src='au')} SELECT row_id, view, {cells(lambda f: f'CASE WHEN mask_{OWNER[f]} THEN 0 ELSE {f} END')} FROM mk",
    digits=5,
)
def two_views(spark, sf):
    return V.two_views(_scaled(spark, sf), FS, fx.GROUPS)


@query("two_views_unmasked", f"WITH {Z}, {_AUG} SELECT row_id, view, {cells(lambda f: f)} FROM au", digits=5)
def two_views_unmasked(spark, sf):
    return V.two_views(_scaled(spark, sf), FS, fx.GROUPS, mode="none")


@query(
    "mask_rates",
    f"""WITH {Z}, {MASKED.format(src='vw')} {' UNION ALL '.join(f"SELECT '{g}' AS {chr(34)}group{chr(34)}, {r(f'avg(CASE WHEN mask_{g} THEN 1.0e0 ELSE 0 END)')} AS rate, 0.25e0 AS expected FROM mk" for g in G)}""",
)
def mask_rates(spark, sf):
    return V.mask_rates(fx.flows(spark, sf).select("row_id"), fx.GROUPS)


LEGACY_F = ["vol_qty", "vol_line", "price_ext", "price_unit", "rate_tax", "vol_size"]
CONT = ["price_ext", "price_unit", "rate_tax"]
SIZE = ["vol_qty", "vol_size"]


def _legacy(f: str) -> str:
    x = f
    if f in CONT:
        x = f"CASE WHEN skip = 0 THEN {x} ELSE {x} + 0.05e0 * sd_{f} * {gauss('row_id', 'view', '=' + f)} END"
    x = f"CASE WHEN skip <> 1 AND {u('row_id', 'view', '=' + f, '=i')} < 0.15e0 THEN 0 ELSE {x} END"
    if f in SIZE:
        x = f"CASE WHEN skip = 2 THEN {x} ELSE ({x}) * (0.9e0 + 0.2e0 * {u('row_id', 'view', '=s')}) END"
    return x


@query(
    "legacy_views",
    f"""WITH {fx.FLOWS}, sd AS (SELECT row_id, {sel(LEGACY_F)}, {sel(f'stddev_pop({f}) OVER () AS sd_{f}' for f in LEGACY_F)} FROM flows),
    vw AS (SELECT sd.*, t.view FROM sd, (VALUES ('a'), ('b')) AS t(view)), sk AS (SELECT *, floor({u('row_id', 'view', '=pick')} * 3) AS skip FROM vw)
    SELECT row_id, view, {sel(f'{r(_legacy(f), 4)} AS {f}' for f in LEGACY_F)} FROM sk""",
    digits=4,
)
def legacy_views(spark, sf):
    return V.legacy_views(fx.flows(spark, sf, spread=True).select("row_id", *LEGACY_F), LEGACY_F, SIZE)


# ---------------------------------------------------------------- representation


def _emb_views(spark, sf):
    wide = V.independent_mask(V.expand_views(fx.emb_wide(spark, sf)), EF, 8)
    views = wide.select("row_id", "view", vector(EF).alias("v"))
    return views.filter("view = 'a'"), views.filter("view = 'b'")


EMB_VIEWS = f"""{fx.EMB}, ev AS (SELECT row_id, t.view, i, CASE WHEN {u('row_id', 'view', "'e' || (i - 1)", '=i')} >= 0.125e0 THEN v[i] ELSE 0 END AS x
    FROM emb, (VALUES ('a'), ('b')) AS t(view), (SELECT CAST(unnest(range(1, {fx.DIM + 1})) AS INTEGER) AS i))"""


@query(
    "vicreg_terms",
    f"""WITH {EMB_VIEWS}, inv AS (SELECT avg(power(a.x - b.x, 2)) AS v FROM ev a JOIN ev b USING (row_id, i) WHERE a.view = 'a' AND b.view = 'b'),
    hinge AS (SELECT avg(greatest(0, 1 - sqrt(s + 1e-4))) AS v FROM (SELECT view, i, var_samp(x) AS s FROM ev GROUP BY 1, 2)),
    cv AS (SELECT a.view, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM ev a JOIN ev b ON a.row_id = b.row_id AND a.view = b.view AND a.i <> b.i GROUP BY 1, 2, 3),
    cov AS (SELECT sum(c * c) / {fx.DIM} / 2 AS v FROM cv)
    SELECT {r('inv.v')} AS invariance, {r('hinge.v')} AS variance, {r('cov.v')} AS covariance, {r('25 * inv.v + 25 * hinge.v + cov.v')} AS loss FROM inv, hinge, cov""",
)
def vicreg_terms(spark, sf):
    va, vb = _emb_views(spark, sf)
    return V.vicreg_terms(va, vb, fx.DIM)


@query("spectral_encoder")
def spectral_encoder(spark, sf):
    va, vb = _emb_views(spark, sf)
    enc = V.spectral_encoder(va, vb, fx.DIM, 8)
    return V.spectral_encode(fx.emb(spark, sf), enc).select("row_id", "h")


def fixed_weights(d: int, hidden: int = 4, latent: int = 3) -> dict:
    """Small given weights that SQL can rebuild from the indices."""
    w = lambda a, b, p, q: np.array([[((i * p + j * q) % 11 - 5) / 10.0 for j in range(b)] for i in range(a)])
    return {
        "W1": w(d, hidden, 7, 3), "b1": np.arange(hidden) / 10.0, "s1": 1.0 + np.arange(hidden) / 20.0, "t1": np.full(hidden, 0.05),
        "W2": w(hidden, latent, 5, 2), "b2": np.arange(latent) / 10.0, "s2": 1.0 + np.arange(latent) / 20.0, "t2": np.full(latent, 0.02),
    }


def encoder_sql(keep: list[int] | None = None) -> str:
    ok = "true" if keep is None else f"i - 1 IN ({', '.join(map(str, keep))})"
    return f"""{fx.EMB}, l1 AS (SELECT row_id, j, greatest(0, (sum(CASE WHEN {ok} THEN v[i] ELSE 0 END * ((((i - 1) * 7 + j * 3) % 11 - 5) / 10.0e0)) + j / 10.0e0) * (1 + j / 20.0e0) + 0.05e0) AS h
      FROM emb, (SELECT CAST(unnest(range(1, {fx.DIM + 1})) AS INTEGER) AS i), (SELECT CAST(unnest(range(4)) AS INTEGER) AS j) GROUP BY 1, 2),
    l2 AS (SELECT row_id, k, greatest(0, (sum(h * (((j * 5 + k * 2) % 11 - 5) / 10.0e0)) + k / 10.0e0) * (1 + k / 20.0e0) + 0.02e0) AS h
      FROM l1, (SELECT CAST(unnest(range(3)) AS INTEGER) AS k) GROUP BY 1, 2),
    lat AS (SELECT row_id, max(CASE WHEN k = 0 THEN h END) AS h0, max(CASE WHEN k = 1 THEN h END) AS h1, max(CASE WHEN k = 2 THEN h END) AS h2 FROM l2 GROUP BY 1)"""


H3 = ", ".join(f"{r(f'h{i}')} AS h{i}" for i in range(3))


def _latent(spark, sf, subset=None):
    out = V.encode(fx.emb(spark, sf), fixed_weights(fx.DIM), subset)
    return out.select("row_id", *[F.col("h")[i].alias(f"h{i}") for i in range(3)])


@query("encode", f"WITH {encoder_sql()} SELECT row_id, {H3} FROM lat")
def encode(spark, sf):
    return _latent(spark, sf)


KEEP = list(range(0, fx.DIM, 3))


@query("encode_masked", f"WITH {encoder_sql(KEEP)} SELECT row_id, {H3} FROM lat")
def encode_masked(spark, sf):
    return _latent(spark, sf, KEEP)


@query(
    "collapse_check",
    f"""WITH {encoder_sql()}, s AS (SELECT unnest([stddev_samp(h0), stddev_samp(h1), stddev_samp(h2)]) AS s FROM lat)
    SELECT {r('avg(s)')} AS mean_std, count(*) FILTER (WHERE s < 0.01) AS n_collapsed FROM s""",
)
def collapse_check(spark, sf):
    return V.collapse_check(V.encode(fx.emb(spark, sf), fixed_weights(fx.DIM)), 3)


@query("pca_95")
def pca_95(spark, sf):
    scores, n, explained = V.pca_95(fx.emb_wide(spark, sf), EF)
    return scores.select("row_id", F.lit(n).alias("n_components"), F.lit(float(sum(explained[:n]))).alias("explained"), "pc")


@query("latent_frontier")
def latent_frontier(spark, sf):
    """Leave-one-out frontier in the latent space of a frozen encoder."""
    from telesift.operators.search import Objective

    table = fx.emb(spark, sf).withColumn("part", F.lit(0))
    obj = Objective(table, fx.DIM, space=V.LatentSpace(fixed_weights(fx.DIM)))
    try:
        obj.choose_k(range(2, 5))
        full = frozenset(range(fx.DIM))
        got = obj.frontier([(0, full - {j}) for j in range(fx.DIM)])
    finally:
        obj.close()
    return spark.createDataFrame([(min(full - s), float(v)) for (_, s), v in got.items()], "removed int, j double")
