"""Trees of many fits over one binned table: splits against enumeration, both ways of growing against each other."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.operators import evaluate as E
from telesift.operators import forest as Fo
from telesift.operators.reports import per_class_table


def naive_split(x, y, w, classes):
    """Best (purity, feature, cut) by trying every cut of every feature."""
    best = (-1.0, -1, 0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            s = 0.0
            for side in (x[:, f] <= cut, x[:, f] > cut):
                c = np.bincount(y[side], w[side], classes)
                s += (c * c).sum() / c.sum()
            if s > best[0] + 1e-9:
                best = (s, f, int(cut))
    return best


@pytest.mark.parametrize("nodes", [1, 40])
def test_splits_against_enumeration(nodes):
    rng = np.random.default_rng(nodes)
    n, d, classes = 400, 4, 3
    x, y, w = rng.integers(0, 12, (n, d)).astype(np.uint8), rng.integers(0, classes, n), rng.integers(1, 4, n).astype(float)
    node = rng.integers(0, nodes, n)
    x[node == 0] = 5  # a node without two values
    fit = Fo.Fit(("t",), 0, 0, classes, tuple(range(d)))
    feature, cut = Fo.best_splits(fit, Fo.mixed(np.arange(nodes)), node, x, y, w)
    for m in range(nodes):
        at = node == m
        want = naive_split(x[at], y[at], w[at], classes)
        if m == 0 or want[1] < 0:
            assert feature[m] == -1
            continue
        got = sum((c * c).sum() / c.sum() for side in (x[at][:, feature[m]] <= cut[m], x[at][:, feature[m]] > cut[m]) for c in [np.bincount(y[at][side], w[at][side], classes)])
        assert got == pytest.approx(want[0])


def test_a_tree_grown_to_purity_knows_its_rows():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 20, (3000, 4)), axis=0).astype(np.uint8)
    y = rng.integers(0, 5, len(x))
    fit = Fo.Fit(("t",), 0, 0, 5, (0, 1, 2, 3))
    got = Fo.grown_votes(fit, 3, x, y, np.ones(len(x)), x)
    assert (got.argmax(axis=1) == y).all() and (got.max(axis=1) == 1).all()
    flat = Fo.grown_votes(Fo.Fit(("t",), 0, 0, 5, (0, 1), depth=2), 3, x, y, np.ones(len(x)), x)
    assert len(np.unique(flat, axis=0)) <= 4
    same = Fo.grown_votes(fit, 3, np.zeros((10, 4), np.uint8), np.arange(10) % 2, np.ones(10), x[:2])
    assert np.allclose(same, [[0.5, 0.5, 0, 0, 0]] * 2)
    assert Fo.grown_votes(fit, 3, x[:0], y[:0], np.ones(0), x[:2]).sum() == 0


def test_bootstrap_weights():
    fit = Fo.Fit(("t",), 0, 0, 2, (0,), bootstrap=True)
    w = Fo.weights(fit, 1, 2, np.arange(20_000))
    assert abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.02
    assert (w != Fo.weights(fit, 1, 3, np.arange(20_000))).mean() > 0.5


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 900
    x = rng.normal(size=(n, 5))
    a = ["low", "mid", "high"]
    rows = [(i, i % 3, a[int(np.digitize(v[0] + 0.3 * v[1], [-0.5, 0.5]))] if i % 50 else None, "p" if v[2] > 0 else "n", *[None if j == 3 and i % 9 == 0 else float("inf") if j == 4 and i % 11 == 0 else float(v[j]) for j in range(5)]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, fold int, size string, sign string, f0 double, f1 double, f2 double, f3 double, f4 double")


def test_both_ways_of_growing_agree(table):
    names = ["f0", "f1", "f2", "f3", "f4"]
    labels, classes = ["size", "sign"], [["high", "low", "mid"], ["n", "p"]]
    t = Fo.prepared(table, names, labels, classes)
    fits = [f for i, c in enumerate(classes) for clf, o in (("rf", {"trees": 3}), ("dt", {}), ("dt", {"depth": 3})) for f in E.tree_fits("all", labels[i], clf, o, [0, 1, 2, 3, 4], i, len(c), range(3))]
    key = lambda rows: {(r["fit"], r["id"]): (r["y"], tuple(np.round(r["votes"], 9))) for r in rows}
    one = key(Fo.votes(t, fits, 5, tasks=3).collect())
    assert len(one) == len(fits) * 300
    assert one == key(Fo.votes(t.repartition(5), fits, 5, small=100).collect())
    assert one == key(Fo.votes(t, fits, 5, tasks=1).collect())


def test_comparison_of_sets(table):
    rows = table.withColumn("flat", F.lit("x"))
    cells = E.evaluate_confusion(rows, {"all": [], "two": ["f0", "f2"]}, {"size": "size", "sign": "sign", "flat": "flat"}, {"rf": {"trees": 15}, "dt": {}, "knn": {}}, ["f0", "f1", "f2", "f3", "f4"], 3)
    sums = {tuple(r)[:4]: r["n"] for r in cells.groupBy("fold", "method", "task", "clf").agg(F.sum("n").alias("n")).collect()}
    known = rows.groupBy("fold").agg(F.count("size").alias("size"), F.count("sign").alias("sign")).collect()
    assert sums == {(r["fold"], m, t, c): r[t] for r in known for m in ("all", "two") for t in ("size", "sign") for c in ("rf", "dt", "knn")}
    scores = {tuple(r)[:4]: r["accuracy"] for r in E.metrics(cells, ["fold", "method", "task", "clf"]).collect()}
    assert min(scores[f, "two", "sign", "dt"] for f in range(3)) > 0.95 and min(scores[f, "all", "size", "rf"] for f in range(3)) > 0.8
    with pytest.raises(ValueError, match="unknown"):
        E.evaluate_confusion(rows, {"all": []}, {"size": "size"}, {"svm": {}}, ["f0"], 3)


def test_a_run_that_was_cut_off_goes_on(spark, table, tmp_path, monkeypatch):
    root, args = f"{tmp_path}/runs", ({"all": [], "two": ["f0", "f2"]}, {"size": "size", "sign": "sign"}, {"dt": {"depth": 4}}, ["f0", "f1", "f2", "f3", "f4"], 3)
    plan = spark.createDataFrame([("d", "p_k3", 42, f, "main") for f in range(3)], "dataset string, protocol string, seed int, fold int, variant string")
    done, evaluate = [], E.evaluate_confusion

    def watched(*a, held_out, **kw):
        if len(done) == 1:
            raise KeyboardInterrupt
        done.append(held_out)
        return evaluate(*a, held_out=held_out, **kw)

    monkeypatch.setattr(E, "evaluate_confusion", watched)
    with pytest.raises(KeyboardInterrupt):
        E.evaluate_runs(table, root, plan, *args, at_once=1)
    done.clear()
    done.append("go on")
    monkeypatch.setattr(E, "evaluate_confusion", lambda *a, held_out, **kw: done.append(held_out) or evaluate(*a, held_out=held_out, **kw))
    got = E.evaluate_runs(table, root, plan, *args, at_once=1).collect()
    assert done == ["go on", [1], [2]]
    assert len(got) == 3 * 2 * 2 and all(len(r["per_class_f1"]) == {"size": 3, "sign": 2}[r["task"]] for r in got)
    assert E.evaluate_runs(table, root, plan, *args).count() == 12 and len(done) == 3
    # the report equals an aggregate of the files themselves
    files = duckdb.connect().execute(f"select content from read_text('{root}/*/*/*/*/*/file=eval.json/*.txt')").fetchall()
    assert len(files) == 3
    stored = [json.loads(f[0])[m]["results"]["size"]["dt"]["per_class_f1"] for f in files for m in ("all", "two")]
    rows = spark.createDataFrame([tuple(r[c] for c in ("protocol", "task", "per_class_f1")) for r in got], "protocol string, task string, per_class_f1 array<double>")
    report = per_class_table(rows.filter("task = 'size'"), ["high", "low", "mid"]).first()
    assert [report[c] for c in ("high", "low", "mid")] == pytest.approx(np.mean(stored, axis=0))


def test_orders_and_histograms_find_the_same_splits(monkeypatch):
    rng = np.random.default_rng(9)
    x, y, w = rng.integers(0, 30, (5000, 3)).astype(np.uint8), rng.integers(0, 4, 5000), rng.integers(1, 3, 5000).astype(float)
    x[:, 2] = 7  # nothing to split
    fit = Fo.Fit(("t",), 0, 0, 4, (0, 1, 2))
    for m in (1, 60, 1500):  # more nodes than a 16-bit key holds beside the bins
        node, got = rng.integers(0, m, 5000), []
        for ratio in (0, 10**9):
            monkeypatch.setattr(Fo, "RATIO", ratio)
            got.append(Fo.best_splits(fit, Fo.mixed(np.arange(m)), node, x, y, w))
        assert (got[0][0] == got[1][0]).all() and (got[0][1] == got[1][1]).all()
        value = x[:, 0].astype(np.int64)
        assert (Fo.sorted_order(node, value, m) == np.argsort(node * 256 + value, kind="stable")).all()


kept = Fo._with_leaves


def test_batches_are_joined_and_training_rows_travel_without_id(table, monkeypatch):
    """Small batches are joined before they are counted, and training rows travel without their id."""
    names, calls = ["f0", "f1", "f2", "f3", "f4"], []
    t = Fo.prepared(table, names, ["sign"], [["n", "p"]])
    fits = E.tree_fits("all", "sign", "dt", {}, [0, 1, 2], 0, 2, range(3))
    batches = t.select("row", "fold", "y", "bins").toArrow().combine_chunks().to_batches(max_chunksize=7)
    assert [b.num_rows for b in Fo.blocks(iter(batches), 300)] == [301, 301, 298]
    cut = batches[3].slice(2, 4)
    assert (Fo.cells_in(cut.column("bins"), 5) == Fo.cells_of(cut.column("bins").to_pylist(), 5)).all()
    monkeypatch.setattr(Fo, "_with_leaves", lambda routed, *a: calls.append(routed) or kept(routed, *a))
    assert Fo.votes(t, fits, 5, small=50).count() == 900
    assert calls[0].filter("held = (id IS NULL)").count() == 0
    sent = calls[0].groupBy("held").count().collect()
    assert {r["held"]: r["count"] for r in sent}[True] == 900


def test_boosted_trees_answer_for_all_folds(spark, sf, monkeypatch):
    """Every fold is held out once, learned from all others, and no option makes the boosted trees smaller."""
    from telesift.plans import model_queries as Q

    asked = []

    def watched(train, test, features, label, clf, **options):
        folds = [{r["fold"] for r in part.select("fold").distinct().collect()} for part in (train, test)]
        asked.append((clf, options, *folds))
        return test.select("fold", F.col(label).alias("y"), F.col(label).alias("p"))

    monkeypatch.setattr(E, "predict", watched)
    scores = {r["fold"]: r["accuracy"] for r in Q.clf_gbt(spark, sf).collect()}
    assert scores == dict.fromkeys(range(5), 1.0)
    assert sorted(asked, key=lambda a: min(a[3])) == [("gbt", {}, set(range(5)) - {f}, {f}) for f in range(5)]
    assert E.clf_gbt().getMaxIter() == 100 and E.clf_gbt().getMaxDepth() == 6


def test_training_rows_are_neither_shuffled_nor_kept(spark, table, monkeypatch):
    """A fit reads its rows from files of a task each, and they are gone when it ends; nothing is persisted beside them."""
    from pathlib import Path

    from telesift.session import scratch_root

    monkeypatch.setattr(E, "TASK_ROWS", 100)
    rows, kept, seen = table.fillna(0.0).replace(float("inf"), 9.0), E.dealt, []
    monkeypatch.setattr(E, "dealt", lambda df: seen.append(kept(df)) or seen[-1])
    left = lambda: {p.name for p in Path(scratch_root(spark), "telesift").glob("training-*")}
    before = left()
    assert E.predict(rows.filter("fold <> 0"), rows.filter("fold = 0"), ["f0", "f1", "f2"], "sign", "gbt", rounds=2, depth=2).count() == 300
    assert not seen[0].is_cached and "Exchange" not in seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert left() == before and "training-" in seen[0].staged_at
