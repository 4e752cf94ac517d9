"""Invariants and brute-force checks of the operators that SQL cannot express."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telesift.operators import evaluate as E
from telesift.operators import explain as X
from telesift.operators import lockstep as L
from telesift.operators import neighbors as N
from telesift.operators import rank as Rk
from telesift.operators import sampling as M
from telesift.operators import search as Se
from telesift.operators import views as V
from telesift.operators.eigen import smooth_eigenvectors
from telesift.operators.graph import knn_graph
from telesift.operators.profile import group_index
from telesift.plans import fixtures as fx
from telesift.sources import runs as R
from telesift.table import FeatureTable


def points(spark, x, kind="bigint"):
    rows = [(str(i) if kind == "string" else i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, f"row_id {kind}, v array<double>")


def brute_knn(x, q, k, exclude):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    if exclude:
        np.fill_diagonal(d, np.inf)
    return {i: list(np.argsort(row, kind="stable")[:k]) for i, row in enumerate(d)}


@pytest.mark.parametrize("exclude", [True, False])
def test_knn_with_a_third_of_equal_rows(spark, exclude):
    rng = np.random.default_rng(0)
    x = np.vstack([np.zeros((100, 3)), rng.normal(size=(200, 3))])
    df = points(spark, x)
    got = N.knn_join(df, df, 4, exclude_self=exclude, cell=16, block=32).collect()
    near = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        near.setdefault(r["row_id"], []).append(r["ref_id"])
    assert near == brute_knn(x, x, 4, exclude)


def test_knn_with_far_outliers_and_few_rows_per_cell(spark):
    rng = np.random.default_rng(1)
    x = np.round(np.vstack([rng.normal(size=(300, 6)), rng.normal(size=(40, 6)) + 20, [[1e6] * 6], [[-3e5, 0, 0, 0, 0, 9]], np.full((3, 6), 50.0)]), 2)
    q = np.vstack([x[::7], [[1e6 + 5] * 6], rng.normal(size=(5, 6)) * 30])
    got = N.knn_join(points(spark, q), points(spark, x), 9, cell=8, block=5).collect()
    near = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        near.setdefault(r["row_id"], []).append(r["ref_id"])
    assert near == brute_knn(x, q, 9, False)
    few = N.knn_join(points(spark, q[:4]), points(spark, x[:3]), 5).collect()
    assert len(few) == 4 * 3
    assert N.knn_join(points(spark, q[:4]), points(spark, x[:0]), 5).count() == 0


def test_knn_pairs_grow_slower_than_all_pairs(spark):
    rng, pairs = np.random.default_rng(2), {}
    for n in (2000, 8000):
        # three dimensions inside of eight, and one row far away from all others
        x = np.vstack([rng.normal(size=(n, 3)) @ rng.normal(size=(3, 8)), np.full((1, 8), 1e5)])
        watch = {}
        df = points(spark, x)
        N.knn_join(df, df, 5, exclude_self=True, cell=64, watch=watch).count()
        pairs[n] = watch["pairs"] + n
        assert watch["cells"] > n / 100
    assert pairs[8000] < pairs[2000] * 4**1.5


def test_knn_votes_lowest_class_wins(spark):
    near = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13)], "row_id int, ref_id int")
    labels = spark.createDataFrame([(10, "b"), (11, "a"), (12, "b"), (13, "a")], "row_id int, label string")
    assert N.knn_votes(near, labels).first()["p"] == "a"


def test_hash_rank_is_one_ranking_per_group(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("row_id"), F.when(F.col("id") < 4000, "hot").otherwise(None).alias("g"))
    got = M.hash_rank(df, ["g"], 1).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.max("rn").alias("m")).collect()
    assert sorted((r["n"], r["d"], r["m"]) for r in got) == [(1000, 1000, 1000), (4000, 4000, 4000)]
    assert M.hash_take(df, ["g"], lambda size: F.least(size, F.lit(1500)), 1).count() == 2500
    assert M.sample_n(df, n=777).count() == 777 and M.sample_n(df, n=9999).count() == 5000


def test_folds_partition_the_rows_and_keep_groups_whole(spark, sf):
    rows = M.group_exec(fx.flows(spark, sf), seconds=86400)
    folds = M.stratified_group_folds(rows, "label2", "grp", 5).persist()
    assert folds.count() == rows.count() == folds.select("row_id").distinct().count()
    assert folds.groupBy("grp").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 2 * min(sizes)
    folds.unpersist()


def spread(counts, fold, k):
    """Mean over the classes of the deviation of their shares among the folds."""
    shares = np.zeros((k, counts.shape[1]))
    np.add.at(shares, fold, counts / counts.sum(axis=0))
    return shares.std(axis=0).mean()


def sequential(counts, k):
    """Groups by falling deviation of their counts, each to the fold that leaves the least spread."""
    loads, fold = np.zeros((k, counts.shape[1])), np.zeros(len(counts), int)
    for g in np.argsort(-counts.std(axis=1), kind="stable"):
        scores = []
        for f in range(k):
            loads[f] += counts[g]
            scores.append((np.round((loads / counts.sum(axis=0)).std(axis=0).mean(), 12), loads[f].sum()))
            loads[f] -= counts[g]
        fold[g] = min(range(k), key=lambda f: scores[f])
        loads[fold[g]] += counts[g]
    return fold


@pytest.mark.parametrize("grouping", ["exec", "device"])
def test_grouped_folds_spread_all_classes(spark, sf, grouping):
    rows = fx.flows(spark, sf.replace("0.001", "0.01"))
    rows = M.group_exec(rows, seconds=86400) if grouping == "exec" else M.group_device(rows)
    found = M.stratified_group_folds(rows, "label2", "grp", 5).groupBy("grp", "fold").pivot("label2").count().fillna(0).toPandas()
    counts = found.drop(columns=["grp", "fold"]).to_numpy(float)
    assert found.grp.is_unique
    assert spread(counts, found.fold.to_numpy(), 5) <= spread(counts, sequential(counts, 5), 5)


def test_grouped_folds_with_more_groups_than_are_dealt_singly(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}", ("a", "b", None)[g % 3 if rng.random() < 0.8 else int(rng.integers(3))]) for g in range(300) for _ in range(int(rng.integers(1, 8)))]
    rows += [("huge", "a")] * 150 + [(None, "b")] * 20
    df = spark.createDataFrame(rows, "grp string, y string")
    got = M.stratified_group_folds(df, "y", "grp", 4, most=40)
    assert got.count() == len(rows)
    assert got.groupBy("grp").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    found = got.groupBy("grp", "fold").pivot("y").count().fillna(0).toPandas()
    counts = found.drop(columns=["grp", "fold"]).to_numpy(float)
    # one group holds more than a quarter of its class
    assert spread(counts, found.fold.to_numpy(), 4) < 0.03


def test_group_index_rejects_bad_assignments(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        group_index(FeatureTable(df, ["a", "b"], groups={"g": ["a"]}))
    with pytest.raises(ValueError):
        group_index(FeatureTable(df, ["a", "b"], groups={"g": ["a", "b"], "h": ["b"]}))
    with pytest.raises(ValueError):
        Rk.get_ranker("nothing")
    with pytest.raises(ValueError):
        V.two_views(df, ["a"], {"g": ["a"]}, mode="other")


def blobs(n=240, d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.zeros((k, d))
    centers[:, :2] = 8 * rng.normal(size=(k, 2))
    lab = np.arange(n) % k
    return centers[lab] + rng.normal(size=(n, d)), lab


def test_lockstep_equals_plain_lloyd(spark):
    x, _ = blobs()
    df = points(spark, x).withColumn("part", F.lit(0))
    start = x[:3].copy()
    mask = np.array([True, True, False, True, False])
    m = L.fit_many(df, [L.Model(0, mask, 3, start.copy())], max_iter=5, tol=-1)[0]
    c = start.copy()
    for _ in range(5):
        lab = ((x[:, None, mask] - c[None][:, :, mask]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[lab == j].mean(axis=0) for j in range(3)])
    assert np.allclose(m.centers, c)


def test_search_improves_strictly_and_budgets_have_their_size(spark):
    x, _ = blobs()
    df = points(spark, np.vstack([x, x[::2]])).withColumn("part", (F.col("row_id") >= len(x)).cast("int"))
    obj = Se.Objective(df, 5, n_init=2)
    try:
        obj.choose_k(range(2, 5))
        found = Se.search(obj)
        budgets = Se.stepwise_budgets(obj, {p: list(range(5)) for p in obj.parts}, [2, 3, 7])
        loo = Se.loo_scores(obj, {p: [0, 1, 2] for p in obj.parts})
    finally:
        obj.close()
    assert set(found) == {0, 1}
    for p, res in found.items():
        js = [h[4] for h in res["history"]]
        assert all(b > a for a, b in zip(js, js[1:])) and len(res["selected"]) >= 2
        assert set(res["selected"]) <= {0, 1} or res["J"] > js[0]
        assert {b: len(s) for b, s in budgets[p].items()} == {2: 2, 3: 3, 7: 5}
        assert set(loo[p]) == {0, 1, 2}
    with pytest.raises(ValueError):
        Se.search(obj, "sideways")


def test_scores_do_not_depend_on_the_path(spark):
    """A subset has one score, whichever subsets were scored before it and in whatever company."""
    x, _ = blobs()
    df = points(spark, x).withColumn("part", F.lit(0)).repartition(3)
    s, t = frozenset({0, 1, 3}), frozenset({0, 2, 3})

    def scored(*order):
        obj = Se.Objective(df, 5)
        try:
            obj.choose_k(range(2, 5))
            for group in order:
                obj.frontier([(0, c) for c in group])
            assert not obj.unfinished
            return obj.k[0], obj.cache[(0, s)]
        finally:
            obj.close()

    (k, alone), after, beside = scored([s]), scored([t], [frozenset(range(4))], [s]), scored([t, s, frozenset({0, 1})])
    assert after[0] == beside[0] == k
    assert np.allclose([after[1], beside[1]], alone, rtol=0, atol=1e-9)


def test_seeds_are_rows_drawn_by_squared_distance(spark):
    """The first start is uniform over the rows and the second goes to the far group, as its squared distances say."""
    x = np.vstack([np.zeros((60, 2)), np.full((3, 2), 9.0)])
    df = points(spark, x).withColumn("part", F.lit(0)).withColumn("row_hash", F.xxhash64("row_id"))
    models = L.seed_many(df, [L.Model(0, np.ones(2, bool), 2, restart=r) for r in range(200)], 7)
    first = np.mean([m.centers[0][0] == 9.0 for m in models])
    assert all(sorted(m.centers[:, 0]) == [0.0, 9.0] for m in models)
    assert abs(first - 3 / 63) < 0.06
    again = L.seed_many(df.repartition(5), [L.Model(0, np.ones(2, bool), 2, restart=r) for r in range(200)], 7)
    assert all((a.centers == b.centers).all() for a, b in zip(models, again))


def test_forest_attributions_add_up(spark):
    x, lab = blobs(200, 4)
    rows = [(i, int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, lab))]
    names = [f"f{j}" for j in range(4)]
    df = spark.createDataFrame(rows, "row_id bigint, cluster int, " + ", ".join(f"{n} double" for n in names))
    model = X.fit_proxy(df, names, trees=7, depth=4)
    phi = X.tree_shap(df, model, names).toPandas()
    base = X.base_values(model)
    assert len(phi) == 200 * len(base)
    from pyspark.ml.functions import vector_to_array

    prob = model.transform(E.assembled(df, names)).select("row_id", vector_to_array("probability").alias("p")).toPandas().set_index("row_id")["p"]
    for r in phi.itertuples(index=False):
        assert base[r.cluster] + sum(r.phi) == pytest.approx(prob[r.row_id][r.cluster], abs=1e-9)
    assert sum(base) == pytest.approx(1.0)


def random_tree(rng, d, k, depth):
    """Node rows of a random tree; features repeat along its paths."""
    rows = []

    def grow(n, level):
        node = len(rows)
        rows.append(None)
        left_n = int(rng.integers(1, n)) if n > 1 and level < depth and rng.random() < 0.9 else 0
        if not left_n:
            stats = rng.multinomial(n, np.ones(k) / k).astype(float)
            rows[node] = (0, node, -1, -1, -1, 0.0, stats)
            return node, stats
        f, cut = int(rng.integers(0, d)), float(np.round(rng.normal(), 1))
        left, a = grow(left_n, level + 1)
        right, b = grow(n - left_n, level + 1)
        rows[node] = (0, node, left, right, f, cut, a + b)
        return node, a + b

    grow(60, 0)
    import pandas as pd

    return pd.DataFrame(rows, columns=["tree", "node", "left", "right", "feature", "cut", "stats"])


def test_attributions_against_all_coalitions():
    import itertools
    from math import factorial

    from telesift.operators import treeshap as T

    rng = np.random.default_rng(3)
    for trial in range(12):
        d, k = 4, 3
        nodes = random_tree(rng, d, k, 6 if trial else 0)
        by_id = {r.node: r for r in nodes.itertuples(index=False)}
        x = np.round(rng.normal(size=(5, d)), 1)

        def value(row, known, node=0):
            r = by_id[node]
            if r.left < 0:
                return r.stats / r.stats.sum()
            if r.feature in known:
                return value(row, known, r.left if row[r.feature] <= r.cut else r.right)
            w = by_id[r.left].stats.sum() / r.stats.sum()
            return w * value(row, known, r.left) + (1 - w) * value(row, known, r.right)

        [table] = T.tree_tables(nodes)
        got = T.forest_attributions([table, table], x)
        assert T.base_of([table, table]) == pytest.approx(value(x[0], set()))
        for i, f in itertools.product(range(len(x)), range(d)):
            rest = [g for g in range(d) if g != f]
            want = sum(
                factorial(len(s)) * factorial(d - 1 - len(s)) / factorial(d) * (value(x[i], {*s, f}) - value(x[i], set(s)))
                for m in range(d)
                for s in itertools.combinations(rest, m)
            )
            assert got[i, :, f] == pytest.approx(want, abs=1e-12)


def test_smooth_eigenvectors_settle(spark):
    x, _ = blobs(90, 3)
    edges = knn_graph(points(spark, x), 5)
    watch = {}
    got = smooth_eigenvectors(edges, 3, watch=watch).toPandas().sort_values("id")
    y = got[["y0", "y1", "y2"]].to_numpy()
    e = edges.toPandas()
    ids = {v: i for i, v in enumerate(got["id"])}
    w = np.zeros((len(ids), len(ids)))
    w[[ids[v] for v in e.src], [ids[v] for v in e.dst]] = e.w
    lap = np.diag(w.sum(axis=1)) - w
    assert np.allclose(y.T @ y, np.eye(3), atol=1e-9) and np.allclose(y.sum(axis=0), 0, atol=1e-7)
    exact = np.linalg.eigvalsh(lap)
    assert watch["top"] >= exact[-1] and np.allclose(watch["values"], exact[1:4], atol=1e-9)
    assert np.linalg.norm(lap @ y - y * watch["values"], axis=0).max() <= 1e-6 * watch["top"]
    with pytest.raises(RuntimeError, match="did not settle"):
        smooth_eigenvectors(edges, 3, tol=1e-15, most=1)
    with pytest.raises(ValueError, match="fewer than"):
        smooth_eigenvectors(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, w double"), 2)


def test_factor_error_never_rises():
    rng = np.random.default_rng(5)
    _, _, errors = Rk.nonnegative_factors(rng.random((8, 8)), 3, steps=60)
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))


def test_spectral_outputs_are_standardised(spark):
    x, _ = blobs(300, 5)
    rng = np.random.default_rng(1)
    va, vb = points(spark, x + 0.1 * rng.normal(size=x.shape)), points(spark, x + 0.1 * rng.normal(size=x.shape))
    enc = V.spectral_encoder(va, vb, 5, 3)
    both = np.array([r["h"] for r in V.spectral_encode(va.unionByName(vb), enc).collect()])
    assert np.allclose(np.cov(both.T), np.eye(3), atol=1e-6)
    assert np.all(np.diff(enc["disagreement"]) >= -1e-12)


def test_run_tree_in_plain_folders(spark, tmp_path):
    scores = {m: 0.5 for m in R.METRICS}
    for fold, done in ((0, True), (1, False)):
        d = tmp_path / "flows" / "sample_k10" / "seed42" / f"fold{fold}" / "main"
        d.mkdir(parents=True)
        body = {"proposed": {"n_features": 3, "features": [0, 1, 2], "results": {"binary": {"rf": scores, "dt": scores}}}}
        (d / "eval.json").write_text(json.dumps(body, indent=1))
        if done:
            (d / "DONE.json").write_text("{}")
    runs = R.scan_runs(spark, str(tmp_path), "eval.json", require_done=True)
    assert [(r["dataset"], r["protocol"], r["seed"], r["fold"], r["variant"]) for r in runs.collect()] == [("flows", "sample_k10", 42, 0, "main")]
    long = R.eval_long(R.scan_runs(spark, str(tmp_path), "eval.json"))
    assert long.count() == 4 and long.filter("n_features = 3 AND f1_macro = 0.5").count() == 4


def test_slow_kmeans_goes_on_until_it_settles(monkeypatch):
    """Evenly spread rows move their centres for more than 300 steps; the sums of a step are taken without Spark."""
    x, steps = np.sort(1000 * ((np.arange(20_000) * 0.6180339887498949) % 1)), []

    def sums(df, models, live, *_):
        c = models[0].centers[:, 0]
        lab = np.searchsorted((c[1:] + c[:-1]) / 2, x)
        steps.append(1)
        return pd.DataFrame({"model": 0, "cluster": np.arange(25), "n": np.bincount(lab, minlength=25), "cost": np.bincount(lab, (x - c[lab]) ** 2, 25), "s0": np.bincount(lab, x, 25)})

    monkeypatch.setattr(L, "_step", sums)
    start = np.sort(np.random.default_rng(0).choice(x, 25, replace=False))[:, None]
    model = L.fit_many(None, [L.Model(0, np.ones(1, bool), 25, start)], max_iter=None, moved=1e-6)[0]
    assert len(steps) > 300 and model.done
    lab = np.abs(x[:, None] - model.centers[:, 0]).argmin(axis=1)
    assert np.allclose(np.bincount(lab, x, 25) / np.bincount(lab, minlength=25), model.centers[:, 0], rtol=0, atol=1e-4)


def test_rows_between_equal_centres_count_once():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    centers = rng.normal(size=(4, 5, 3))
    centers[1, 4] = centers[1, 2]  # equal centres: the first one gets the rows
    x[7] = (centers[2, 0] + centers[2, 1]) / 2
    keep = np.array([[1, 1, 1], [1, 1, 1], [0, 1, 1], [1, 0, 0]], float)
    n, cost, sums = L._sums(x, centers, keep)
    gaps = L._gaps(x, centers, keep)
    for i in range(4):
        d = (((x[:, None, :] - centers[i][None]) * keep[i]) ** 2).sum(axis=2)
        lab = d.argmin(axis=1)
        if i == 1:
            assert n[i, 4] == 0
        assert n[i].sum() == len(x) and np.abs(n[i] - np.bincount(lab, minlength=5)).max() <= 1
        assert cost[i] == pytest.approx(d.min(axis=1).sum()) and np.allclose(gaps[:, i], d.min(axis=1))
        assert np.allclose(sums[i].sum(axis=0), x.sum(axis=0))


def test_starts_of_all_k_are_drawn_together(spark):
    df = points(spark, np.random.default_rng(5).normal(size=(200, 2))).selectExpr("0 AS part", "v", "xxhash64(row_id) AS row_hash").persist()
    model = lambda k, r: L.Model(0, np.ones(2, bool), k, restart=r)
    apart = [L.seed_many(df, [model(k, r)], 7)[0].centers for r in (0, 1) for k in (2, 5, 3)]
    models = [model(k, r) for r in (0, 1) for k in (2, 5, 3)]
    held, sent = spark.sparkContext.broadcast, []
    spark.sparkContext.broadcast = lambda v: sent.append(len(v)) or held(v)
    try:
        together = L.seed_many(df, models, 7)
    finally:
        del spark.sparkContext.broadcast
    assert sent == [2] * 5  # one race per restart in every step
    assert all(a is b for a, b in zip(together, models, strict=True))
    assert [m.centers.tolist() for m in together] == [c.tolist() for c in apart]
    assert [len(m.centers) for m in together] == [2, 5, 3] * 2


@pytest.mark.parametrize("far", [0.0, 1e9, 1e200])
def test_nearest_pairs_by_product_are_those_of_direct_differences(far, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 6)), 1) + far
    y = np.vstack([x[:150], x[:50], np.round(rng.normal(size=(90, 6)), 1) + far])  # equal rows and equal distances
    reach, own = np.where(np.arange(300) % 3 == 0, 2.0, np.inf), np.where(np.arange(300) < 150, np.arange(300), -1)
    d = N.distances(x, y)
    d[np.arange(150), np.arange(150)] = np.inf
    d[d > reach[:, None]] = np.inf
    direct = []
    monkeypatch.setattr(N, "distances", lambda a, b: direct.append(len(a)) or np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)))
    for cells in (1000, 2_000_000):
        got: dict = {}
        for i, j, v in zip(*N.nearest_pairs(x, y, 4, reach, own, cells), strict=True):
            got.setdefault(int(i), []).append((int(j), round(float(v), 9)))
        for i in range(300):
            order = [int(j) for j in np.argsort(d[i], kind="stable")[:4] if np.isfinite(d[i, j])]
            assert [v for _, v in got.get(i, [])] == [round(float(d[i, j]), 9) for j in order]
            if far == 0.0 or far == 1e200:
                assert [j for j, _ in got.get(i, [])] == order
    assert bool(direct) == (far == 1e200)  # only what the product cannot hold is compared directly


def test_batched_digests_are_md5_for_texts_of_any_length():
    import hashlib

    from telesift.functions.hashing import heads

    starts = [("42|" + "x" * n + str(i)).encode() for n in (0, 1, 2, 3, 31, 47, 60) for i in range(150)] + [b""]
    ends = [b"", b"|a|u", b"|rate_discount|v"]
    got = heads(starts, ends)
    for j, e in enumerate(ends):
        assert got[j].tolist() == [int.from_bytes(hashlib.md5(s + e).digest()[:8]) for s in starts]


def test_batched_draws_are_those_of_the_expressions(spark):
    """Noise, dropout and masks take their draws in batches; null, empty and repeated keys draw what the expressions draw."""
    from telesift.functions.hashing import normal, uniform

    rows = [(str(i), 1.0, 2.0 * i) for i in range(300)] + [(None, 3.0, None), ("", 1.0, 1.0), ("é" * 40, 5.0, 1.0), ("7", 1.0, 14.0)]
    df = V.expand_views(spark.createDataFrame(rows, "row_id string, x double, y double"))
    key = [F.col("row_id"), F.col("view")]
    noisy = V.noise(df, ["x", "y"])
    assert "ArrowEvalPython" in noisy._jdf.queryExecution().toString()
    both = ("row_id", "view", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
    want = df.select("row_id", "view", *[(F.col(c) + F.lit(0.05) * normal(42, *key, c)).alias(c) for c in ("x", "y")])
    assert sorted(map(str, noisy.select(*both).collect())) == sorted(map(str, want.select(*both).collect()))
    for got, kind, p in ((V.feature_dropout(df, ["x", "y"]).select("row_id", "view", "x", "y"), "d", 0.1), (V.independent_mask(df, ["x", "y"], 4).select("row_id", "view", "x", "y"), "i", 0.25)):
        want = df.select("row_id", "view", *[F.when(uniform(42, *key, c, kind) >= p, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("x", "y")])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    """A task of a fit holds a bounded number of rows, however few files they come from."""
    monkeypatch.setattr(E, "TASK_ROWS", 100)
    rows = spark.range(1000, numPartitions=2)
    got = E.dealt(rows)
    assert got.rdd.getNumPartitions() == 10 and got.count() == 1000
    assert E.dealt(spark.range(100, numPartitions=2)).rdd.getNumPartitions() == 2


def _counted(df, seen):
    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema)


def test_the_first_time_is_read_once(spark):
    """Blocks of time are counted from a literal, so a job on them does not read the rows a second time."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, datetime(2024, 3, 1) + timedelta(seconds=50 * i)) for i in range(40)] + [(40, None)], "row_id int, ts timestamp")
    got = M.group_time(_counted(rows, seen), seconds=300)
    found = {r.row_id: r.grp for r in got.collect()}
    assert seen.value == 82
    assert [r.grp for r in got.collect()].count("0") == 6 and found[39] == "6" and found[40] is None
    assert seen.value == 123
    assert M.group_time(rows.limit(0)).count() == 0


def test_whole_table_scaling_fits_in_one_scan(spark):
    from telesift.operators import scaling as S

    seen = spark.sparkContext.accumulator(0)
    rows = [(i, float(i % 5) if i % 7 else None, 2.0, float("inf") if i % 11 == 0 else float(i)) for i in range(50)]
    df = _counted(spark.createDataFrame(rows, "row_id int, a double, b double, c double"), seen)
    out, kept = S.clean_and_scale(df, [], ["row_id"])
    assert seen.value == 50 and kept == ["a", "c"]
    slim = df.select("row_id", "a", "c")
    want = S.apply_scaler(slim, S.fit_scaler(slim, kept), kept)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
