"""Comparison tables over long result tables (dataset, protocol, seed, fold, variant, method, task, clf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.operators.profile import base_method
from telesift.operators.stability import compare, jaccard_pairs, nogueira, paired, run_sizes, subset_sizes, verdict

CLFS = ("rf", "dt", "knn")
TASKS = ("binary", "multiclass")


def only(ev: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        ev = ev.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return ev


def avg_if(cond: Column, c: str) -> Column:
    return F.avg(F.when(cond, F.col(c)))


def std_if(cond: Column, c: str) -> Column:
    return F.stddev_pop(F.when(cond, F.col(c)))


def natural_points(ev: DataFrame, dataset: str, methods: list[str], seed: int = 42, protocol: str = "sample_k10") -> DataFrame:
    """Each method at its own subset size: mean over classifiers first, then over folds."""
    d = only(ev, dataset=dataset, protocol=protocol, seed=seed, variant="main", method=methods)
    metrics = ["f1_macro", "accuracy", "mcc", "recall_macro", "precision_macro"]
    pick = lambda clf, m: F.max(F.when(F.col("clf") == clf, F.col(m)))
    per_fold = d.groupBy("method", "task", "fold").agg(
        *[F.avg(m).alias(m) for m in metrics],
        *[pick(c, "f1_macro").alias(f"f1_{c}") for c in CLFS],
        *[pick("rf", m).alias(f"rf_{m}") for m in ("recall_macro", "precision_macro", "mcc")],
        F.sum("n_features").alias("nf_sum"),
        F.count(F.lit(1)).alias("nf_n"),
        F.min("n_features").alias("nf_min"),
        F.max("n_features").alias("nf_max"),
        F.collect_set("clf").alias("clfs"),
    )
    is_task = {t: F.col("task") == t for t in TASKS}
    multi = is_task["multiclass"]
    return per_fold.groupBy("method").agg(
        F.countDistinct("fold").alias("n_folds"),
        (F.sum("nf_sum") / F.sum("nf_n")).alias("n_features_mean"),
        F.min("nf_min").alias("n_features_min"),
        F.max("nf_max").alias("n_features_max"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("clfs")))), "/").alias("classifiers"),
        *[f for t in TASKS for f in (avg_if(is_task[t], "f1_macro").alias(f"{t}_f1_mean"), std_if(is_task[t], "f1_macro").alias(f"{t}_f1_std"))],
        *[
            f
            for t in TASKS
            for c in CLFS
            for f in (avg_if(is_task[t], f"f1_{c}").alias(f"{t}_f1_{c}_mean"), std_if(is_task[t], f"f1_{c}").alias(f"{t}_f1_{c}_std"))
        ],
        avg_if(multi, "accuracy").alias("acc"),
        avg_if(multi, "mcc").alias("mcc"),
        avg_if(multi, "recall_macro").alias("recall"),
        avg_if(multi, "precision_macro").alias("precision"),
        avg_if(multi, "rf_recall_macro").alias("rf_recall"),
        avg_if(multi, "rf_precision_macro").alias("rf_precision"),
        avg_if(multi, "rf_mcc").alias("rf_mcc"),
    )


SIG_KEYS = ["dataset", "task", "clf"]


def significance(
    ev: DataFrame, refs: list[str], seeds: list[int] | None, protocol: str = "sample_k10", clfs: tuple[str, ...] = ("rf", "dt"),
    proposed: str = "proposed",
) -> DataFrame:
    """All (dataset, task, classifier, reference) comparisons in one job."""
    pairs = paired(only(ev, protocol=protocol, clf=list(clfs)), proposed, refs, SIG_KEYS, seeds=seeds)
    keys = [*SIG_KEYS, "reference"]
    seed_list = pairs.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("seed")), lambda s: s.cast("string")), "+").alias("seeds")
    )
    return compare(pairs, keys).join(seed_list, keys)


def multiseed(ev: DataFrame, dataset: str, methods: list[str], protocol: str = "sample_k10") -> DataFrame:
    """Per seed: mean and population deviation over folds."""
    d = only(ev, dataset=dataset, protocol=protocol, variant="main", method=methods, clf=["rf", "dt"])
    return d.groupBy("seed", "method", "task", "clf").agg(
        F.avg("f1_macro").alias("f1_mean"),
        F.stddev_pop("f1_macro").alias("f1_std"),
        F.countDistinct("fold").alias("n_folds"),
        F.avg("n_features").alias("nf_mean"),
    )


def multiseed_pooled(per_seed: DataFrame) -> DataFrame:
    """Across seeds: mean of the seed means; sample deviation, NULL for a single seed."""
    return per_seed.groupBy("method", "task", "clf").agg(
        F.avg("f1_mean").alias("seed_mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("f1_mean")).alias("seed_std"),
        F.min("f1_mean").alias("seed_min"),
        F.max("f1_mean").alias("seed_max"),
        F.countDistinct("seed").alias("n_seeds"),
    )


def budget_table(
    ev: DataFrame, dataset: str, searches: list[str], rankers: list[str], budgets: list[int], seed: int = 42,
    protocol: str = "sample_k10",
) -> DataFrame:
    """Forest scores at fixed subset sizes; only folds with exactly b features count."""
    d = only(ev, dataset=dataset, protocol=protocol, seed=seed, variant="main", task="multiclass", clf="rf")
    names = [(f"{m}_b{b}" if m in searches else f"{m}_{b}", m, b) for m in [*searches, *rankers] for b in budgets]
    names += [("all_features", "all_features", b) for b in budgets]
    spec = ev.sparkSession.createDataFrame(names, "method string, base string, b int")
    wanted = spec.select("base", "b").join(
        d.join(F.broadcast(spec), "method").filter((F.col("base") == "all_features") | (F.col("n_features") == F.col("b"))).select("base", "b", "f1_macro"),
        ["base", "b"],
        "left",
    )
    at = lambda b: F.col("b") == b
    cells = [
        c
        for b in budgets
        for c in (
            avg_if(at(b), "f1_macro").alias(f"k{b}_mean"),
            std_if(at(b), "f1_macro").alias(f"k{b}_std"),
            F.count(F.when(at(b), F.col("f1_macro"))).alias(f"k{b}_n"),
        )
    ]
    return wanted.groupBy(F.col("base").alias("method")).agg(*cells)


def budget_delta(table: DataFrame, budgets: list[int]) -> DataFrame:
    """Best method per budget and the change from the first to the last budget."""
    ranked = F.col("method") != "all_features"
    whole = Window.partitionBy()
    best = lambda b: F.max(F.when(ranked, F.col(f"k{b}_mean"))).over(whole)
    flags = [(ranked & F.coalesce(F.abs(F.col(f"k{b}_mean") - best(b)) < 5e-4, F.lit(False))).alias(f"best_k{b}") for b in budgets]
    change = F.col(f"k{budgets[0]}_mean") - F.col(f"k{budgets[-1]}_mean")
    return table.select("method", *flags, F.when(ranked, change).alias("delta"))


def protocol_table(ev: DataFrame, dataset: str, methods: list[str], seed: int = 42) -> DataFrame:
    d = only(ev, dataset=dataset, variant="main", seed=seed, method=methods, clf=["rf", "dt"])
    return d.groupBy("protocol", "method", "task", "clf").agg(
        F.avg("f1_macro").alias("f1_mean"),
        F.stddev_pop("f1_macro").alias("f1_std"),
        F.avg("accuracy").alias("acc"),
        F.avg("mcc").alias("mcc"),
        F.avg("recall_macro").alias("recall"),
        F.countDistinct("fold").alias("n_folds"),
        F.avg("n_features").alias("nf"),
    )


def per_class_table(runs: DataFrame, classes: list[str]) -> DataFrame:
    """Mean F1 per class and protocol; runs that report another number of classes are left out."""
    complete = runs.filter(F.size("per_class_f1") == len(classes))
    return complete.groupBy("protocol").agg(
        *[F.avg(F.col("per_class_f1")[i]).alias(c) for i, c in enumerate(classes)]
    )


EXTRAS_TYPE = (
    "struct<k:int,cluster_sizes:array<bigint>,silhouette:double,"
    "stability_resample:struct<ari_mean:double,ari_min:double,ami_mean:double,ami_min:double,n_pairs:int>,"
    + ",".join(
        f"{p}:struct<n:bigint,accuracy:double,balanced_accuracy:double,macro_f1:double>"
        for p in ("proxy_in_sample", "proxy_heldout_internal", "proxy_heldout_test_fold")
    )
    + ">"
)


def extras_table(runs: DataFrame) -> DataFrame:
    """Cluster stability and proxy scores of each run, from its stored JSON."""
    e = runs.withColumn("e", F.from_json("value", EXTRAS_TYPE))
    sizes = F.col("e.cluster_sizes")
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    proxies = {"ins": "proxy_in_sample", "hoi": "proxy_heldout_internal", "hot": "proxy_heldout_test_fold"}
    names = {"acc": "accuracy", "bacc": "balanced_accuracy", "f1": "macro_f1"}
    return e.select(
        "protocol", "seed", "fold", "e.k", "e.silhouette",
        F.col("e.stability_resample.ari_mean").alias("ari_resample"),
        F.col("e.stability_resample.ami_mean").alias("ami_resample"),
        F.col("e.stability_resample.ari_min").alias("ari_resample_min"),
        (F.array_min(sizes) / total).alias("min_cluster_share"),
        (F.array_max(sizes) / total).alias("max_cluster_share"),
        *[F.col(f"e.{p}.{src}").alias(f"{tag}_{dst}") for tag, p in proxies.items() for dst, src in names.items()],
    )


def extras_summary(extras: DataFrame) -> DataFrame:
    nums = [c for c in extras.columns if c not in ("protocol", "seed", "fold")]
    return extras.groupBy("protocol").agg(
        *[f for c in nums for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"))]
    )


def ablation_table(
    ev: DataFrame, dataset: str, variants: dict[str, str], controls: dict[str, str], budgets: list[int],
    probe: str = "aug_independent", protocol: str = "sample_k10", seed: int = 42,
) -> DataFrame:
    """Variants on the folds they share, then the control searches of the main variant."""
    d = only(ev, dataset=dataset, protocol=protocol, seed=seed)
    folds = only(ev, dataset=dataset, variant=probe, method="proposed").select("fold").distinct()
    common = only(d, variant=list(variants)).join(folds, "fold", "left_semi")
    label = lambda col, names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(col)]
    own = F.col("method") == "proposed"
    cell = lambda t, c: own & (F.col("task") == t) & (F.col("clf") == c)
    at = lambda b: (F.col("method") == f"proposed_b{b}") & (F.col("task") == "multiclass") & (F.col("clf") == "rf")
    top = common.groupBy(label("variant", variants).alias("configuration")).agg(
        F.countDistinct("fold").alias("n_folds"),
        avg_if(own, "n_features").alias("n_features"),
        *[avg_if(cell(t, c), "f1_macro").alias(f"{t}_{c}") for t in TASKS for c in ("rf", "dt")],
        *[avg_if(at(b), "f1_macro").alias(f"rf_b{b}") for b in budgets],
    )
    rf = lambda t: (F.col("task") == t) & (F.col("clf") == "rf")
    low = only(d, variant="main", method=list(controls)).groupBy(label("method", controls).alias("configuration")).agg(
        F.countDistinct("fold").alias("n_folds"),
        F.avg("n_features").alias("n_features"),
        *[avg_if(rf(t), "f1_macro").alias(f"{t}_rf") for t in TASKS],
    )
    return top.unionByName(low, allowMissingColumns=True)


def ablation_paired(
    ev: DataFrame, dataset: str, mask_budgets: list[int], search_budgets: list[int], protocol: str = "sample_k10", seed: int = 42,
) -> DataFrame:
    """Controlled comparisons that change one component; at least five folds each.

    A small table names the two sides of each comparison, so all pairs come from one join
    of the scores with themselves.
    """
    mask, back, space = "group vs independent masking", "bidirectional vs backward-only", "latent vs raw search"
    spec = [(f"{mask} (natural subset)", "main", "proposed", "aug_independent", "proposed", ["rf", "dt"], list(TASKS), None)]
    spec += [(f"{mask} (budget k={b})", "main", f"proposed_b{b}", "aug_independent", f"proposed_b{b}", ["rf"], ["multiclass"], None) for b in mask_budgets]
    spec += [(back, "main", "proposed", "main", "proposed_backward_only", ["rf"], list(TASKS), None)]
    spec += [(f"{space} at the same size", "main", "proposed", "main", "kmeans_sil_at_nprop", ["rf"], list(TASKS), None)]
    spec += [(f"{space} (budget k={b})", "main", f"proposed_b{b}", "main", f"kmeans_sil_b{b}", ["rf"], ["multiclass"], b) for b in search_budgets]
    sides = F.broadcast(
        ev.sparkSession.createDataFrame(
            spec, "comparison string, va string, ma string, vb string, mb string, clfs array<string>, tasks array<string>, size int"
        )
    )
    d = only(ev, dataset=dataset, protocol=protocol, seed=seed).select("variant", "method", "task", "clf", "fold", "n_features", "f1_macro")
    # a control that was not evaluated again takes the score of the subset it coincides with:
    # backward-only equals the full search, the raw search at |S*| equals the raw natural subset of that size
    key = ["task", "clf", "fold"]
    seen = lambda m: F.max(F.col("method") == m).over(Window.partitionBy("variant", *key))
    size_of = lambda m: F.max(F.when(F.col("method") == m, F.col("n_features"))).over(Window.partitionBy("variant", *key))
    twin = F.when((F.col("method") == "proposed") & ~seen("proposed_backward_only"), "proposed_backward_only").when(
        (F.col("method") == "kmeans_sil") & ~seen("kmeans_sil_at_nprop") & (size_of("kmeans_sil") == size_of("proposed")),
        "kmeans_sil_at_nprop",
    )
    d = d.withColumn("_twin", twin)
    d = d.withColumn("method", F.explode(F.array_compact(F.array("method", "_twin"))))
    wanted = F.array_contains("clfs", F.col("clf")) & F.array_contains("tasks", F.col("task")) & (
        F.col("size").isNull() | (F.col("n_features") == F.col("size"))
    )
    match = lambda v, m: (F.col("variant") == F.col(v)) & (F.col("method") == F.col(m)) & wanted
    a = d.join(sides, match("va", "ma")).select("comparison", *key, F.col("f1_macro").alias("a"))
    b = d.join(sides, match("vb", "mb")).select("comparison", *key, F.col("f1_macro").alias("b"))
    out = compare(a.join(b, ["comparison", *key]), ["comparison", "task", "clf"], tie=1e-12).filter("n_pairs >= 5")
    return out.select(
        "comparison", "task", "clf", "n_pairs", "mean_a", "mean_b", "mean_diff", "n_positive", "n_negative", "wilcoxon_p", "tost_p"
    )


def ablation_selection(sel: DataFrame, d: int, n_folds: int = 5) -> DataFrame:
    """Subset size, Jaccard and chance-corrected stability per variant on the first folds."""
    s = sel.filter(F.col("fold") < n_folds)
    sizes = subset_sizes(s, d, ["variant"]).select("variant", "n_runs", "size_mean", "size_min", "size_max")
    jac = jaccard_pairs(s, d, ["variant"]).groupBy("variant").agg(F.avg("jaccard").alias("jaccard_mean"))
    ks = s.select("variant", "run_id", "k_star").distinct().groupBy("variant").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("k_star")), lambda k: k.cast("string")), ",").alias("k_star")
    )
    nog = nogueira(s, d, ["variant"]).select("variant", "nogueira")
    return sizes.filter("n_runs >= 2").join(jac, "variant").join(nog, "variant").join(ks, "variant")


def fold_summary(metrics: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Mean and population deviation of each metric over folds, with the reduction ratio."""
    names = [m for m in ("f1_macro", "accuracy", "precision_macro", "recall_macro", "mcc") if m in metrics.columns]
    nf = F.avg("n_features")
    return metrics.groupBy(*keys).agg(
        nf.alias("n_features"),
        (1 - nf / d).alias("reduction_ratio"),
        *[f for m in names for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))],
    )


def mean_over_classifiers(cv: DataFrame, keys: list[str] = ("method",)) -> DataFrame:
    return cv.groupBy(*keys).agg(
        F.avg("n_features").alias("n_features"),
        F.avg("f1_macro_mean").alias("f1_mean"),
        F.avg("f1_macro_std").alias("f1_std"),
        F.avg("accuracy_mean").alias("acc_mean"),
        F.avg("mcc_mean").alias("mcc_mean"),
    )


def best_classifier(cv: DataFrame) -> DataFrame:
    """The classifier with the highest macro-F1 per method; its own deviation beside it."""
    best = F.max_by(F.struct("clf", "f1_macro_mean", "f1_macro_std"), F.struct("f1_macro_mean", "clf"))
    return cv.groupBy("method").agg(
        best.alias("b"), F.max("accuracy_mean").alias("acc_mean"), F.max("mcc_mean").alias("mcc_mean")
    ).select("method", F.col("b.clf").alias("best_clf"), F.col("b.f1_macro_mean").alias("f1_mean"), F.col("b.f1_macro_std").alias("f1_std"), "acc_mean", "mcc_mean")


def method_scenario_pivot(cv: DataFrame, order: list[str], scenarios: list[str]) -> DataFrame:
    """Method x task table in a fixed method order; methods outside the order come last."""
    summary = mean_over_classifiers(cv, ["method", "task"])
    cells = [f for s in scenarios for f in (avg_if(F.col("task") == s, "f1_mean").alias(f"{s}_f1"), avg_if(F.col("task") == s, "f1_std").alias(f"{s}_std"))]
    table = summary.groupBy("method").agg(F.avg("n_features").alias("n_features"), *cells)
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    slot = F.when(place > 0, place).otherwise(F.lit(len(order) + 1))
    return table.withColumn("rank", F.row_number().over(Window.orderBy(slot, "method")))


def method_classifier_pivot(cv: DataFrame, clfs: tuple[str, ...] = CLFS) -> DataFrame:
    """Method x classifier table ranked by the row mean."""
    table = cv.groupBy("method").pivot("clf", list(clfs)).agg(F.avg("f1_macro_mean"))
    filled = F.filter(F.array(*clfs), lambda x: x.isNotNull())
    mean = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x) / F.size(filled)
    return table.withColumn("row_mean", mean).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("row_mean"), "method")))


def step_deltas(cv: DataFrame, steps: dict[str, list[str]]) -> DataFrame:
    """Contribution of each step: best method of a step minus the best of the step before."""
    means = cv.groupBy("method").agg(F.avg("f1_macro_mean").alias("value"))
    spec = cv.sparkSession.createDataFrame(
        [(i, s, m) for i, (s, ms) in enumerate(steps.items()) for m in ms], "step int, name string, method string"
    )
    best = means.join(F.broadcast(spec), "method").groupBy("step", "name").agg(
        F.max_by("method", F.struct("value", "method")).alias("method"), F.max("value").alias("value")
    )
    before = F.lag("value").over(Window.orderBy("step"))
    return best.withColumn("delta", F.coalesce(F.col("value") - before, F.lit(0.0)))


def gain_over_best(cv: DataFrame, proposed: str, ignore: list[str]) -> DataFrame:
    means = cv.groupBy("method").agg(F.avg("f1_macro_mean").alias("value"))
    own = F.max(F.when(F.col("method") == proposed, F.col("value")))
    rest = F.max(F.when(~F.col("method").isin(proposed, *ignore), F.col("value")))
    return means.agg(own.alias("proposed"), rest.alias("best_baseline"), (own - rest).alias("gain"))


def k_sweep_curve(cv: DataFrame, clf: str = "rf") -> DataFrame:
    """Score curve per base method over the subset size in the method's name."""
    k = F.regexp_extract("method", r"_[kb]?(\d+)$", 1)
    d = only(cv, clf=clf).filter(k != "")
    return d.groupBy(base_method(F.regexp_replace("method", r"_b(\d+)$", "_$1")).alias("base"), k.cast("int").alias("k")).agg(
        F.avg("f1_macro_mean").alias("f1_mean"),
        F.avg("f1_macro_std").alias("f1_std"),
        F.avg(F.col("f1_macro_mean") - F.col("f1_macro_std")).alias("lower"),
        F.avg(F.col("f1_macro_mean") + F.col("f1_macro_std")).alias("upper"),
    )


def often_removed(freq: DataFrame, removed_now: DataFrame, reference: list[str], cut: float = 0.8) -> DataFrame:
    """Features below the selection-frequency cut, rarest first, with their flags."""
    low = freq.filter(F.col("selection_frequency") < cut).join(
        F.broadcast(removed_now.select("pos", F.lit(True).alias("removed_now"))), "pos", "left"
    )
    return low.select(
        F.row_number().over(Window.orderBy("selection_frequency", "pos")).alias("rank"),
        "feature",
        "grp",
        (F.col("n_runs") - F.col("n_selected")).alias("n_removed"),
        "n_runs",
        F.coalesce("removed_now", F.lit(False)).alias("removed_now"),
        F.col("feature").isin(reference).alias("in_reference"),
    )


def cross_dataset(sig: DataFrame, tasks: tuple[str, ...] = TASKS, clf: str = "rf") -> DataFrame:
    """Difference, p-values and verdict per dataset and reference, one column block per task."""
    d = only(sig, clf=clf).withColumn("verdict", verdict(F.col("mean_diff"), F.col("wilcoxon_p"), F.col("tost_p")))
    cells = [
        F.max(F.when(F.col("task") == t, F.col(src))).alias(f"{t}_{dst}")
        for t in tasks
        for src, dst in (("mean_diff", "diff"), ("wilcoxon_p", "wilcoxon"), ("tost_p", "tost"), ("verdict", "verdict"))
    ]
    return d.groupBy("dataset", "reference").agg(*cells)


def seeds_table(per_seed: DataFrame, sel: DataFrame, d: int, methods: list[str]) -> DataFrame:
    """Subset size and k* per seed beside the scores of the methods."""
    sizes = run_sizes(sel, d, ["seed", "run_id", "k_star"]).groupBy("seed").agg(
        F.avg("n_selected").alias("size_mean"),
        F.min("n_selected").alias("size_min"),
        F.max("n_selected").alias("size_max"),
        F.min("k_star").alias("k_min"),
        F.max("k_star").alias("k_max"),
    )
    pick = lambda m, t, c, v: F.max(F.when((F.col("method") == m) & (F.col("task") == t) & (F.col("clf") == c), F.col(v)))
    scores = per_seed.groupBy("seed").agg(
        *[f for t in TASKS for m in methods for f in (pick(m, t, "rf", "f1_mean").alias(f"{m}_{t}_rf"), pick(m, t, "rf", "f1_std").alias(f"{m}_{t}_rf_std"))],
        *[pick(m, "multiclass", "dt", "f1_mean").alias(f"{m}_multiclass_dt") for m in methods],
    )
    return sizes.join(scores, "seed")
