"""Confusion counts and the metrics built on them, for any number of runs at once."""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.functions.exprs import null_safe_join
from telesift.operators.forest import Fit, predicted, prepared
from telesift.session import scratch_path, stage, unstage
from telesift.sources.runs import RUN_KEYS, eval_cells, scan_runs, unfinished, write_runs


def confusion(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Cell counts (keys, y, p, n): the only pass over the predictions."""
    return pred.groupBy(*keys, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Per class: hits, true rows and predicted rows. Classes that occur on either side appear."""
    cell = F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("true_n"), F.col("n").alias("pred_n")),
    )
    hit = F.when((F.col("y") == F.col("p")) & (F.col("true_n") > 0), F.col("n")).otherwise(0)
    return (
        conf.select(*keys, "y", "p", "n", F.inline(cell))
        .groupBy(*keys, "cls")
        .agg(F.sum(hit).alias("tp"), F.sum("true_n").alias("true_n"), F.sum("pred_n").alias("pred_n"))
    )


def _scores(counts: DataFrame) -> DataFrame:
    """Per-class precision, recall and F1; 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, t, p = F.col("tp"), F.col("true_n"), F.col("pred_n")
    return (
        counts.withColumn("precision", ratio(tp, p))
        .withColumn("recall", ratio(tp, t))
        .withColumn("f1", ratio(2 * tp, t + p))
    )


def per_class_scores(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs in y."""
    s = _scores(class_counts(conf, keys)).filter("true_n > 0")
    return s.select(*keys, "cls", "precision", "recall", "f1", F.col("true_n").alias("support"))


def per_class_f1(conf: DataFrame, keys: list[str], classes: DataFrame | None = None) -> DataFrame:
    """F1 per class. `classes` (keys, cls) names the classes of a run, those of its training and test labels: a class
    without test rows or predictions appears with F1 0. Without it, the classes in y or p appear."""
    s = _scores(class_counts(conf, keys)).select(*keys, "cls", "f1", F.col("true_n").alias("support"))
    if classes is None:
        return s
    all_ = null_safe_join(classes.select(*keys, "cls").distinct(), s, [*keys, "cls"], "left")
    return all_.select(*keys, "cls", F.coalesce("f1", F.lit(0.0)).alias("f1"), F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))


def fold_classes(labels: DataFrame, fold: str = "fold", y: str = "y") -> DataFrame:
    """(fold, cls): the classes of the training and test rows of every fold, that is of all rows."""
    every = labels.agg(F.sort_array(F.collect_set(y)).alias("c")).scalar()
    return labels.select(fold).distinct().withColumn("_all", every).select(fold, F.explode("_all").alias("cls"))


def metrics(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Macro F1, precision and recall over classes in y or p, accuracy and multiclass MCC."""
    s = _scores(class_counts(conf, keys))
    agg = s.groupBy(*keys).agg(
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.sum("tp").cast("double").alias("c"),
        F.sum("true_n").cast("double").alias("n"),
        F.sum(F.col("true_n").cast("double") * F.col("pred_n")).alias("tpd"),
        F.sum(F.col("true_n").cast("double") * F.col("true_n")).alias("tt"),
        F.sum(F.col("pred_n").cast("double") * F.col("pred_n")).alias("pp"),
    )
    n = F.col("n")
    spread = (n * n - F.col("pp")) * (n * n - F.col("tt"))
    mcc = F.when(spread > 0, (F.col("c") * n - F.col("tpd")) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return agg.select(
        *keys, "f1_macro", (F.col("c") / n).alias("accuracy"), "precision_macro", "recall_macro", mcc.alias("mcc")
    )


def fidelity(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 over the classes present in y."""
    s = _scores(class_counts(conf, keys)).filter("true_n > 0")
    return s.groupBy(*keys).agg(
        F.sum("true_n").alias("n"),
        (F.sum("tp") / F.sum("true_n")).alias("accuracy"),
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.count(F.lit(1)).alias("n_classes"),
    )


# ---------------------------------------------------------------- classifiers

FEATURES, LABEL = "_features", "_label"
TASK_ROWS = 250_000  # training rows in one task


def class_names(df: DataFrame, label: str) -> list[str]:
    """Lexicographic class list (one entry per class)."""
    return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="error").transform(df)


def indexed(df: DataFrame, features: list[str], label: str, names: list[str]) -> DataFrame:
    """Training rows as (vector of the chosen features, lexicographic class index)."""
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)) - 1
    return assembled(df, features).select(FEATURES, index.cast("double").alias(LABEL))


def dealt(rows: DataFrame) -> DataFrame:
    """The rows staged in files of at most TASK_ROWS, a task each: fits hold rows decoded, many times the size of their files.

    Nothing is shuffled for that, and nothing but the fit's own tables is kept beside the files. They are read by a
    session of their own, as what a task takes is set for a whole session.
    """
    spark = rows.sparkSession
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    path = scratch_path(spark, "training")
    rows.write.option("maxRecordsPerFile", TASK_ROWS).parquet(path)
    out = own.read.parquet(path)
    out.staged_at = path
    return out


def clf_rf(trees: int = 100, depth: int = 15, seed: int = 42, bins: int = 64):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, maxMemoryInMB=512)


def clf_dt(depth: int = 15, seed: int = 42, bins: int = 64):
    from pyspark.ml.classification import DecisionTreeClassifier

    return DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, maxDepth=depth, maxBins=bins, seed=seed)


def clf_gbt(rounds: int = 100, depth: int = 6, classes: int = 2, seed: int = 42):
    """Boosted trees; several classes are handled one against the rest."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    gbt = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=rounds, maxDepth=depth, seed=seed)
    return gbt if classes <= 2 else OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol=LABEL)


CLASSIFIERS = {"rf": clf_rf, "dt": clf_dt, "gbt": clf_gbt}


def clf_knn(train: DataFrame, test: DataFrame, features: list[str], labels: list[str], k: int = 5, id_col: str = "row_id") -> DataFrame:
    """k-nearest-neighbour classes of the test rows: one neighbour join, one vote per label column."""
    from telesift.functions.linalg import vector
    from telesift.operators.neighbors import knn_join, knn_votes

    near = knn_join(test.withColumn("v", vector(features)), train.withColumn("v", vector(features)), k, id_col)
    out = test.select(id_col, *labels)
    for label in labels:
        votes = knn_votes(near, train, id_col, label).withColumnRenamed("p", f"p_{label}")
        out = out.join(votes, id_col)
    return out


def predict(train: DataFrame, test: DataFrame, features: list[str], label: str, clf: str, names: list[str] | None = None, **kw) -> DataFrame:
    """(id columns.., y, p): fit on the training rows, predict the test rows as class names."""
    if clf not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {clf}; known: {sorted([*CLASSIFIERS, 'knn'])}")
    names = names or class_names(train, label)
    if clf == "gbt":
        kw = {"classes": len(names), **kw}
    rows = dealt(indexed(train, features, label, names))
    try:
        model = CLASSIFIERS[clf](**kw).fit(rows)
    finally:
        unstage(train.sparkSession, rows.staged_at)
    name_of = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int") + 1)
    keep = [c for c in test.columns if c not in features]
    return model.transform(assembled(test, features)).select(*keep, F.col(label).alias("y"), name_of.alias("p"))


def tree_fits(method: str, task: str, clf: str, options: dict, cols: list[int], label: int, classes: int, folds) -> list[Fit]:
    """The fits of one cell of the comparison, one per fold: trees to purity, a root of the features tried per node in a forest."""
    forest = clf == "rf"
    trees, depth = options.get("trees", 100 if forest else 1), options.get("depth")
    tried = max(1, isqrt(len(cols))) if forest else None
    return [Fit((f, method, task, clf, len(cols)), f, label, classes, tuple(cols), trees, tried, forest, depth) for f in folds]


def fits_confusion(df: DataFrame, fits: list[Fit], features: list[str], labels: list[str], names: list[list[str]], id_col: str = "row_id", fold: str = "fold", **options) -> DataFrame:
    """Cells (fold, method, task, clf, n_features, y, p, n) of all fits from one binned table."""
    table = prepared(df, features, labels, names, id_col, fold)
    cells = predicted(table, fits, len(features), **options).filter("y >= 0").groupBy("fit", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    lines = [(i, *fit.name, names[fit.label][:]) for i, fit in enumerate(fits)]
    known = df.sparkSession.createDataFrame(lines, "fit int, fold int, method string, task string, clf string, n_features int, names array<string>")
    name = lambda c: F.element_at("names", F.col(c) + 1).alias(c)
    return cells.join(F.broadcast(known), "fit").select("fold", "method", "task", "clf", "n_features", name("y"), name("p"), "n")  # a line per fit


def evaluate_confusion(
    df: DataFrame, sets: dict[str, list[str]], tasks: dict[str, str], classifiers: dict[str, dict], features: list[str], k: int,
    fold: str = "fold", id_col: str = "row_id", held_out: list[int] | None = None,
) -> DataFrame:
    """Confusion cells of many subsets x classifiers x tasks on given folds (all k of them, or those of `held_out`).

    Trees of all subsets, folds and tasks grow from one binned table (they need no scaling). Nearest neighbours and
    boosted trees run per fold and subset on the scaled training part. Tasks with fewer than two classes are skipped; an
    empty set stands for all features.
    """
    from telesift.operators.scaling import apply_scaler, fit_scaler_training

    if unknown := set(classifiers) - {*CLASSIFIERS, "knn"}:
        raise ValueError(f"unknown classifiers {sorted(unknown)}; known: {sorted([*CLASSIFIERS, 'knn'])}")
    counts = df.agg(*[F.countDistinct(c).alias(t) for t, c in tasks.items()]).first().asDict()
    live = {t: c for t, c in tasks.items() if counts[t] >= 2}
    names = {t: class_names(df.filter(F.col(c).isNotNull()), c) for t, c in live.items()}
    chosen = {m: cols or features for m, cols in sets.items()}
    held = list(range(k)) if held_out is None else held_out
    fits = [
        fit
        for clf in ("rf", "dt") if clf in classifiers
        for m, cols in chosen.items()
        for i, t in enumerate(live)
        for fit in tree_fits(m, t, clf, classifiers[clf], [features.index(c) for c in cols], i, len(names[t]), held)
    ]
    keys = ["fold", "method", "task", "clf", "n_features"]
    parts = [fits_confusion(df, fits, features, list(live.values()), list(names.values()), id_col, fold)] if fits else []
    single = [c for c in classifiers if c in ("knn", "gbt")]
    if single:
        stats = stage(fit_scaler_training(df, features, k, fold), "scalers")
    for f in held if single else []:
        scaled = stage(apply_scaler(df, stats.filter(F.col("eval_fold") == f), features).select(id_col, fold, *live.values(), *features), "scaled")
        train, test = scaled.filter(F.col(fold) != f), scaled.filter(F.col(fold) == f)
        for m, cols in chosen.items():
            for clf in single:
                if clf == "knn":
                    got = clf_knn(train, test, cols, list(live.values()), id_col=id_col, **classifiers[clf])
                    pairs = {t: got.select(F.col(c).alias("y"), F.col(f"p_{c}").alias("p")) for t, c in live.items()}
                else:
                    pairs = {t: predict(train, test, cols, c, clf, names[t], **classifiers[clf]) for t, c in live.items()}
                for t, pred in pairs.items():
                    at = [F.lit(v).alias(n) for n, v in zip(keys, (f, m, t, clf, len(cols)), strict=True)]
                    parts.append(confusion(pred.filter("y IS NOT NULL"), []).select(*at, "y", "p", "n"))
    return stage(reduce(DataFrame.unionByName, parts), "cells")


def evaluate_sets(
    df: DataFrame, sets: dict[str, list[str]], tasks: dict[str, str], classifiers: dict[str, dict], features: list[str], k: int,
    fold: str = "fold", id_col: str = "row_id",
) -> DataFrame:
    """Cross-validated metrics of many subsets x classifiers x tasks on given folds."""
    return metrics(evaluate_confusion(df, sets, tasks, classifiers, features, k, fold, id_col), ["fold", "method", "task", "clf", "n_features"])


def evaluate_runs(
    df: DataFrame, root: str, plan: DataFrame, sets: dict[str, list[str]], tasks: dict[str, str], classifiers: dict[str, dict], features: list[str], k: int,
    at_once: int = 5, **columns,
) -> DataFrame:
    """From folds to a run tree that can be resumed: results, F1 of every class and a mark for each run of the plan.

    `plan` has a line per run: its keys, where `fold` is the fold held out. Runs that the tree marks as done are not
    repeated; `at_once` runs are evaluated together and committed before the next ones. Returns the whole tree as cells.
    """
    spark = df.sparkSession
    todo = sorted((tuple(r) for r in unfinished(plan.select(*RUN_KEYS), root).collect()), key=lambda r: (r[:3], r[4], r[3]))
    for i in range(0, len(todo), at_once):
        runs = spark.createDataFrame(todo[i : i + at_once], "dataset string, protocol string, seed int, fold int, variant string")
        cells = evaluate_confusion(df, sets, tasks, classifiers, features, k, held_out=sorted({r[3] for r in todo[i : i + at_once]}), **columns)
        keys = ["fold", "method", "task", "clf", "n_features"]
        every = {t: class_names(df.filter(F.col(c).isNotNull()), c) for t, c in tasks.items()}
        names = spark.createDataFrame([(t, c) for t, known in every.items() for c in known], "task string, cls string")
        classes = cells.select(*keys).distinct().join(F.broadcast(names), "task")  # a line per class
        by_class = per_class_f1(cells, keys, classes).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("cls", "f1"))), lambda s: s["f1"]).alias("per_class_f1"))
        scores = metrics(cells, keys).join(by_class, keys)
        write_runs(runs.join(scores, "fold"), root, runs)
    return eval_cells(scan_runs(spark, root, "eval.json", require_done=True))
