"""Stability of selected subsets and paired significance tests over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.functions.tails import normal_sf, student_t_sf

EXACT_LIMIT = 50  # exact null distribution up to this many non-zero differences


# ---------------------------------------------------------------- subsets


def run_sizes(sel: DataFrame, d: int, keys: list[str] = ("run_id", "seed", "fold")) -> DataFrame:
    return sel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_selected")).withColumn(
        "n_removed", F.lit(d) - F.col("n_selected")
    )


def selection_frequency(sel: DataFrame, features: DataFrame) -> DataFrame:
    """Share of runs (all, and per seed) that select each feature; never-selected ones count 0."""
    runs = sel.select("run_id", "seed").distinct()
    seeds = [r["seed"] for r in runs.select("seed").distinct().orderBy("seed").collect()]
    n_runs = runs.agg(
        F.count(F.lit(1)).alias("n_runs"), *[F.sum((F.col("seed") == s).cast("long")).alias(f"n_{s}") for s in seeds]
    )
    hits = sel.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_selected"), *[F.sum((F.col("seed") == s).cast("long")).alias(f"h_{s}") for s in seeds]
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        features.join(F.broadcast(hits), "pos", "left")
        .withColumn("_r", n_runs.select(F.struct("*")).scalar())
        .select(
            "pos",
            "feature",
            "grp",
            zero("n_selected").alias("n_selected"),
            F.col("_r.n_runs").alias("n_runs"),
            (zero("n_selected") / F.col("_r.n_runs")).alias("selection_frequency"),
            *[(zero(f"h_{s}") / F.col("_r")[f"n_{s}"]).alias(f"freq_seed{s}") for s in seeds],
        )
    )


def frequency_counts(freq: DataFrame, cut: float = 0.8) -> DataFrame:
    """Number of features selected always, never, and in at least the given share of runs."""
    f = F.col("selection_frequency")
    n = lambda c: F.sum(c.cast("long"))
    return freq.agg(n(f == 1).alias("n_always"), n(f == 0).alias("n_never"), n(f >= cut).alias("n_often"))


def subset_sizes(sel: DataFrame, d: int, by: list[str] = ()) -> DataFrame:
    s = F.col("n_selected")
    return run_sizes(sel, d, [*by, "run_id"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg(s).alias("size_mean"),
        F.stddev_pop(s).alias("size_std"),
        F.min(s).alias("size_min"),
        F.median(s).alias("size_median"),
        F.max(s).alias("size_max"),
    )


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_pairs(sel: DataFrame, d: int, by: list[str] = ()) -> DataFrame:
    """Jaccard similarity of the selected and of the removed sets for each pair of runs.

    The runs of a group are gathered in one row (their number is set by the experiment plan, not by the data) and paired there.
    """
    everything = F.sequence(F.lit(0), F.lit(d - 1))
    runs = sel.groupBy(*by, "run_id", "seed").agg(F.sort_array(F.collect_set("pos")).alias("s"))
    runs = runs.withColumn("rest", F.array_except(everything, "s"))
    group = runs.groupBy(*by).agg(F.collect_list(F.struct("run_id", "seed", "s", "rest")).alias("_all"))
    first = group.select(*by, "_all", F.explode("_all").alias("_a"))
    pairs = first.select(*by, "_a", F.explode(F.filter("_all", lambda x: x["run_id"] > F.col("_a.run_id"))).alias("_b"))
    sides = [F.col(f"_{x}.{c}").alias(f"{c}_{x}") for x in ("a", "b") for c in ("run_id", "seed", "s", "rest")]
    return pairs.select(*by, *sides).select(
        *by,
        "run_id_a",
        "run_id_b",
        (F.col("seed_a") == F.col("seed_b")).alias("same_seed"),
        jaccard(F.col("s_a"), F.col("s_b")).alias("jaccard"),
        jaccard(F.col("rest_a"), F.col("rest_b")).alias("jaccard_removed"),
    )


def jaccard_summary(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    within = F.when(F.col("same_seed"), F.col("jaccard"))
    across = F.when(~F.col("same_seed"), F.col("jaccard"))
    return pairs.groupBy(*by).agg(
        F.avg(within).alias("within_seed_mean"),
        F.min(within).alias("within_seed_min"),
        F.avg(across).alias("across_seed_mean"),
        F.avg("jaccard").alias("all_mean"),
        F.avg("jaccard_removed").alias("removed_all_mean"),
    )


def nogueira(sel: DataFrame, d: int, by: list[str] = ()) -> DataFrame:
    """Chance-corrected stability 1 - mean(M/(M-1) p(1-p)) / (k/d (1-k/d)); NULL if undefined."""
    runs = sel.groupBy(*by).agg(F.countDistinct("run_id").alias("m"), F.count(F.lit(1)).alias("total"))
    hits = sel.groupBy(*by, "pos").agg(F.count(F.lit(1)).alias("c"))
    joined = hits.join(runs, by) if by else hits.withColumn("_r", runs.select(F.struct("*")).scalar()).select(
        "pos", "c", "_r.m", "_r.total"
    )
    p = F.col("c") / F.col("m")
    per = joined.groupBy(*by, "m", "total").agg(F.sum(p * (1 - p)).alias("spread"))
    share = F.col("total") / F.col("m") / d
    denom = share * (1 - share)
    value = 1 - F.col("m") / (F.col("m") - 1) * F.col("spread") / d / denom
    return per.select(*by, F.col("m").alias("n_runs"), F.when((F.col("m") > 1) & (denom != 0), value).alias("nogueira"))


def k_counts(runs: DataFrame, k: str = "k_star") -> DataFrame:
    """Histogram of the chosen number of clusters, also as one text value."""
    hist = runs.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(k, "n"))), lambda s: F.concat(s[k], F.lit(":"), s["n"])), ","
    )
    return hist.agg(text.alias("k_counts"), F.sum("n").alias("n_runs"))


# ---------------------------------------------------------------- paired tests


def paired(
    ev: DataFrame, method_a: str, refs: list[str], keys: list[str], variant_a: str = "main", variant_b: str = "main",
    seeds: list[int] | None = None, metric: str = "f1_macro",
) -> DataFrame:
    """Scores of one method beside each reference on the same seed and fold."""
    if seeds is not None:
        ev = ev.filter(F.col("seed").isin(seeds))
    a = ev.filter((F.col("variant") == variant_a) & (F.col("method") == method_a))
    b = ev.filter((F.col("variant") == variant_b) & F.col("method").isin(refs))
    on = [*keys, "seed", "fold"]
    return a.select(*on, F.col(metric).alias("a"), F.col("n_features").alias("n_features_a")).join(
        b.select(*on, F.col("method").alias("reference"), F.col(metric).alias("b"), F.col("n_features").alias("n_features_b")),
        on,
    )


def _signed_ranks(pairs: DataFrame, keys: list[str], diff: Column) -> DataFrame:
    """Doubled mid-ranks of the non-zero differences, gathered per comparison."""
    nz = pairs.select(*keys, diff.alias("_d")).filter("_d <> 0").withColumn("_abs", F.abs("_d"))
    first = F.rank().over(Window.partitionBy(*keys).orderBy("_abs"))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_abs"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    nz = nz.select(*keys, "_d", (2 * first + ties - 1).alias("r2"), ties.alias("t"), size.alias("m"))
    return nz.groupBy(*keys).agg(
        F.max("m").alias("m"),
        F.sum(F.when(F.col("_d") > 0, F.col("r2")).otherwise(0)).alias("w2"),
        F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("tie"),
        F.collect_list(F.when(F.col("m") <= EXACT_LIMIT, F.col("r2").cast("int"))).alias("ranks"),
    )


def _with_tails(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """P(W >= w) and P(W <= w): exact by convolving the ranks, normal for long samples."""
    total = (F.col("m") * (F.col("m") + 1)).cast("int")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    exact = F.col("m") <= EXACT_LIMIT
    start = F.when(exact, F.concat(F.array(F.lit(1.0)), zeros(total))).otherwise(F.array(F.lit(1.0)))
    ranks = ranks.withColumn("_start", start)
    counts = F.aggregate(
        "ranks",
        F.col("_start"),
        lambda acc, r: F.zip_with(
            acc, F.concat(zeros(r), F.slice(acc, F.lit(1), F.size(acc) - r)), lambda x, y: x + y
        ),
    )
    ranks = ranks.withColumn("_counts", counts)
    mass = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    w = F.col("w2").cast("int")
    ways = F.pow(F.lit(2.0), F.col("m"))
    size = F.size("_counts")
    at_least = F.when(exact, mass(F.slice("_counts", F.least(w + 1, size), F.greatest(size - w, F.lit(0)))) / ways)
    at_most = F.when(exact, mass(F.slice("_counts", F.lit(1), F.least(w + 1, size))) / ways)
    m = F.col("m").cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("tie") / 48
    z = (F.col("w2") / 2 - m * (m + 1) / 4) / F.sqrt(var)
    out = ranks.select(*keys, "m", (F.col("w2") / 2).alias("w_plus"), at_least.alias("_ge"), at_most.alias("_le"), z.alias("_z"))
    return out.select(
        *keys,
        "m",
        "w_plus",
        F.coalesce("_ge", normal_sf(F.col("_z"))).alias("p_greater"),
        F.coalesce("_le", normal_sf(-F.col("_z"))).alias("p_less"),
    )


def signed_rank_tests(pairs: DataFrame, keys: list[str], shifts: list[float]) -> DataFrame:
    """Signed-rank tails of a - b + shift for each shift, from one pass over the pairs."""
    on = [*keys, "shift"]
    long = pairs.withColumn("shift", F.explode(F.array(*[F.lit(float(s)) for s in shifts])))
    sizes = long.groupBy(*on).agg(F.count(F.lit(1)).alias("n_pairs"))
    tails = _with_tails(_signed_ranks(long, on, F.col("a") - F.col("b") + F.col("shift")), on)
    return sizes.join(tails, on, "left")


_ENOUGH = "n_pairs >= 5"


def _two_sided() -> Column:
    # least() skips NULL, so a sample without differences needs its own test
    return F.when(F.col("p_greater").isNotNull(), F.least(F.lit(1.0), 2 * F.least("p_greater", "p_less")))


def wilcoxon(pairs: DataFrame, keys: list[str], shift: float = 0.0) -> DataFrame:
    """Signed-rank test of a - b + shift per comparison: two-sided, greater and less.

    Zeros are dropped and ties get mid-ranks. NULL with fewer than five pairs or with no
    difference at all.
    """
    ok = F.expr(_ENOUGH)
    return signed_rank_tests(pairs, keys, [shift]).select(
        *keys,
        "n_pairs",
        "w_plus",
        F.when(ok, _two_sided()).alias("p_two_sided"),
        F.when(ok, F.col("p_greater")).alias("p_greater"),
        F.when(ok, F.col("p_less")).alias("p_less"),
    )


def _tost_p(delta: float) -> Column:
    """Larger of the two one-sided p-values; a sample without any difference cannot reject."""
    ok = F.expr(_ENOUGH)
    low = F.max(F.when((F.col("shift") == delta) & ok, F.coalesce("p_greater", F.lit(1.0))))
    high = F.max(F.when((F.col("shift") == -delta) & ok, F.coalesce("p_less", F.lit(1.0))))
    return F.when(low.isNotNull() & high.isNotNull(), F.greatest(low, high))


def tost(pairs: DataFrame, keys: list[str], delta: float = 0.01) -> DataFrame:
    """Paired equivalence: the larger p of two one-sided signed-rank tests at +/- delta."""
    return signed_rank_tests(pairs, keys, [delta, -delta]).groupBy(*keys).agg(_tost_p(delta).alias("tost_p"))


def _t_test(stats: DataFrame) -> DataFrame:
    """Adds t and its p-values to (n_pairs, mean_diff, sd_diff)."""
    t = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n_pairs")))
    out = stats.withColumn("t", t).withColumn("t_p_one", student_t_sf(F.col("t"), (F.col("n_pairs") - 1).cast("double")))
    return out.withColumn("t_p_two", 2 * F.least("t_p_one", 1 - F.col("t_p_one"))).drop("sd_diff")


def paired_t(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Paired t statistic with its two-sided and one-sided (a > b) p-value; NULL without spread."""
    d = F.col("a") - F.col("b")
    stats = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff")
    )
    return _t_test(stats).select(*keys, "t", "t_p_two", "t_p_one")


def compare(pairs: DataFrame, keys: list[str], delta: float = 0.01, alpha: float = 0.05, tie: float = 0.0) -> DataFrame:
    """One record per comparison: means, differences, wins and losses, tests and flags."""
    d = F.col("a") - F.col("b")
    n = lambda c: F.sum(c.cast("long"))
    base = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(d).alias("mean_diff"),
        F.stddev_pop(d).alias("std_diff"),
        F.stddev_samp(d).alias("sd_diff"),
        F.min(d).alias("diff_min"),
        F.max(d).alias("diff_max"),
        n(d > tie).alias("n_positive"),
        n(d < -tie).alias("n_negative"),
    )
    plain = (F.col("shift") == 0) & F.expr(_ENOUGH)
    tests = signed_rank_tests(pairs, keys, [0.0, delta, -delta]).groupBy(*keys).agg(
        F.max(F.when(plain, _two_sided())).alias("wilcoxon_p"),
        F.max(F.when(plain, F.col("p_greater"))).alias("wilcoxon_p_greater"),
        _tost_p(delta).alias("tost_p"),
    )
    out = _t_test(base.join(tests, keys))
    return out.withColumn("sig_wilcoxon", F.coalesce(F.col("wilcoxon_p_greater") < alpha, F.lit(False))).withColumn(
        "sig_t", F.coalesce(F.col("t_p_one") < alpha, F.lit(False))
    )


def verdict(diff: Column, p_w: Column, p_t: Column, alpha: float = 0.05) -> Column:
    differs = F.coalesce(p_w < alpha, F.lit(False))
    same = F.coalesce(p_t < alpha, F.lit(False))
    tag = F.when(same, F.lit(" (equiv.)")).otherwise(F.lit(""))
    return (
        F.when(differs & (diff > 0), F.concat(F.lit("Superior"), tag))
        .when(differs & (diff < 0), F.concat(F.lit("Inferior"), tag))
        .when(same, F.lit("Equivalent"))
        .otherwise(F.lit("Inconclusive"))
    )
