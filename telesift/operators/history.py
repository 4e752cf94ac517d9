"""Search logs, chosen subsets, and the plans of evaluations and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def csv_of(col: str):
    return F.array_join(F.sort_array(F.collect_set(col)), ",")


def path_subsets(history: DataFrame, d: int, run: str = "run_id") -> DataFrame:
    """Replay of add/remove steps: the subset at each cardinality; the last step of a size wins.

    Each event holds until the next event of the same feature, so membership is a set of
    step intervals rather than a sequential loop.
    """
    last = history.groupBy(run).agg(F.max("step").alias("_last"))
    start = last.select(run, F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("pos"), F.lit(0).alias("step"), F.lit("add").alias("action"))
    events = start.unionByName(history.filter(F.col("pos").isNotNull()).select(run, "pos", "step", "action"))
    until = F.lead("step").over(Window.partitionBy(run, "pos").orderBy("step"))
    spans = events.withColumn("_next", until).filter("action = 'add'").join(last, run)
    members = spans.withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("_last"))).filter("_to >= step").select(
        run, "pos", F.explode(F.sequence("step", "_to")).alias("t")
    )
    steps = members.groupBy(run, "t").agg(F.count(F.lit(1)).alias("n"), csv_of("pos").alias("subset"))
    return steps.groupBy(run, "n").agg(F.max_by("subset", "t").alias("subset"), F.max("t").alias("step"))


def search_summary(history: DataFrame, d: int, run: str = "run_id") -> DataFrame:
    n = lambda a: F.sum((F.col("action") == a).cast("long"))
    size = F.max_by("n", "step")
    return history.groupBy(run).agg(
        F.max("step").alias("n_steps"),
        n("remove").alias("n_removals"),
        n("add").alias("n_forward_additions"),
        size.alias("n_selected"),
        (1 - size / d).alias("reduction_ratio"),
        F.min_by("j", "step").alias("j_full"),
        F.max_by("j", "step").alias("j_selected"),
    )


def complete_ranking(selected: DataFrame, ranking: DataFrame, variances: DataFrame) -> DataFrame:
    """Chosen features by falling variance, then the others in ranking order."""
    marked = ranking.join(F.broadcast(selected.select("pos", F.lit(True).alias("chosen"))), "pos", "left").join(
        F.broadcast(variances.select("pos", "var")), "pos"
    )
    chosen = F.coalesce("chosen", F.lit(False))
    order = Window.orderBy(
        F.desc(chosen), F.when(chosen, F.col("var")).desc_nulls_last(), F.when(chosen, -F.col("pos")).otherwise(F.col("rank"))
    )
    return marked.select(F.row_number().over(order).alias("rank"), "pos", chosen.alias("chosen"))


def eval_plan(
    sets: DataFrame, done: DataFrame, level: str, variant: str = "main", knn: bool = True,
    budgets: tuple[int, ...] = (), tasks: tuple[str, ...] = ("binary", "multiclass"),
) -> DataFrame:
    """Which (run, method, classifier, task) to evaluate at a level, without finished methods.

    ``sets`` holds (run_id, method, family, budget); family is one of proposed, all, search,
    ranking, reference, control and budget.
    """
    if level not in ("full", "seed", "ablation", "descriptive"):
        raise ValueError(f"unknown level {level}")
    fam = F.col("family")
    main = F.lit(variant == "main")
    wanted = (fam == "proposed") | ((fam == "all") & main)
    if level == "full":
        wanted = wanted | fam.isin("search", "ranking", "reference", "control", "budget")
    if level == "ablation" and budgets:
        wanted = wanted | ((fam == "budget") & F.col("method").startswith("proposed") & F.col("budget").isin(min(budgets), max(budgets)))
    if level == "descriptive":
        wanted = F.lit(False)
    everywhere = ["rf", "dt"] + (["knn"] if knn and level == "full" else [])
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    forest_only = fam.isin("control", "budget")
    plan = sets.filter(wanted).join(done.select("run_id", "method").distinct(), ["run_id", "method"], "left_anti")
    return (
        plan.withColumn("clf", F.explode(F.when(forest_only, lits(["rf"])).otherwise(lits(everywhere))))
        .withColumn("task", F.explode(F.when(fam == "budget", lits([tasks[-1]])).otherwise(lits(tasks))))
        .select("run_id", "method", "clf", "task")
    )


def usable_labels(df: DataFrame, candidates: list[str], limit: int = 2) -> DataFrame:
    """Label columns with at least two classes, in preference order."""
    present = [c for c in candidates if c in df.columns]
    wide = df.agg(*[F.countDistinct(c).alias(c) for c in present])
    long = wide.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("pref"), F.lit(c).alias("label"), F.col(c).alias("n_classes")) for i, c in enumerate(present)]))
    )
    ranked = long.filter("n_classes >= 2").withColumn("rank", F.row_number().over(Window.orderBy("pref")))
    return ranked.filter(F.col("rank") <= limit).select("rank", "label", "n_classes")


GRID_SCHEMA = "priority int, dataset string, protocol string, n_splits int, seed int, n_folds int, level string, variant string"


def experiment_grid(spec: DataFrame, done: DataFrame) -> DataFrame:
    """One line per job in priority order, without finished runs."""
    jobs = spec.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1)))
    keys = ["dataset", "protocol", "seed", "fold", "variant"]
    todo = jobs.join(done.select(*keys).distinct(), keys, "left_anti")
    return todo.select("priority", *keys, "n_splits", "level")
