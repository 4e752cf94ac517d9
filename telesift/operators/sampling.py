"""Samples, splits and folds in md5 order, safe against hot groups.

A plain ``row_number() over (partition by group order by md5)`` sends a whole group to
one task. Here every group is cut into 16**prefix md5 ranges: one small aggregate counts
the rows per (group, range), a running sum of these counts gives each range its offset,
and the row number is taken inside the range only. The result is the same exact rank,
but a group that holds a third of all rows is spread over thousands of equal tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.functions.exprs import null_safe_join
from telesift.functions.hashing import digest, uniform
from telesift.session import stage

PREFIX = 3


def _keyed(df: DataFrame, id_col: str, seed, prefix: int) -> DataFrame:
    return df.withColumn("_h", digest(seed, F.col(id_col))).withColumn("_b", F.substring("_h", 1, prefix))


def _ranges(keyed: DataFrame, by: list[str]) -> DataFrame:
    counts = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_size"),
    )


def _numbered(keyed: DataFrame, ranges: DataFrame, by: list[str], id_col: str, name: str) -> DataFrame:
    # one struct key (NULL groups equal each other) serves the join and the window: one shuffle
    key = F.struct(*by, "_b").alias("_k")
    facts = [c for c in ranges.columns if c not in (*by, "_b")]
    joined = keyed.withColumn("_k", key).join(ranges.select(key, *facts), "_k")
    inner = Window.partitionBy("_k").orderBy("_h", id_col)
    return joined.withColumn(name, F.col("_before") + F.row_number().over(inner)).drop("_k")


def hash_rank(
    df: DataFrame, by: list[str], seed, id_col: str = "row_id", name: str = "rn", size: str | None = None,
    prefix: int = PREFIX,
) -> DataFrame:
    """Exact row number of every row inside its group, in md5 order; optional group size."""
    keyed = _keyed(df, id_col, seed, prefix)
    out = _numbered(keyed, _ranges(keyed, by), by, id_col, name)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_h", "_b", "_before", "_size")


def hash_take(
    df: DataFrame, by: list[str], quota: Callable[[Column], Column], seed, id_col: str = "row_id",
    prefix: int = PREFIX, extra: DataFrame | None = None,
) -> DataFrame:
    """The first ``quota(group size)`` rows of every group in md5 order.

    Ranges that lie wholly behind the quota are dropped by the range join, before any
    row is shuffled. ``extra`` adds columns per group that the quota may use.
    """
    keyed = _keyed(df, id_col, seed, prefix)
    ranges = _ranges(keyed, by)
    if extra is not None:
        ranges = null_safe_join(ranges, extra, by, "left")
    ranges = ranges.withColumn("_quota", quota(F.col("_size"))).filter("_before < _quota")
    ranges = ranges.select(*by, "_b", "_before", "_quota")
    out = _numbered(keyed, ranges, by, id_col, "_rn").filter("_rn <= _quota")
    return out.select(*df.columns)


def sample_n(df: DataFrame, n: int | None = None, frac: float | None = None, seed=42, id_col: str = "row_id") -> DataFrame:
    """Uniform sample without replacement: exactly n rows, or a rounded share of all rows."""
    if (n is None) == (frac is None):
        raise ValueError("give either n or frac")
    quota = (lambda size: F.lit(n)) if n is not None else (lambda size: F.bround(size * F.lit(frac)))
    return hash_take(df, [], quota, seed, id_col)


def sample_p(df: DataFrame, p: float, seed=42, id_col: str = "row_id") -> DataFrame:
    """Every row is kept with probability p, independently; a pure filter."""
    return df.filter(uniform(seed, F.col(id_col)) < p)


def sample_stratified(df: DataFrame, by: str, n: int, seed=42, id_col: str = "row_id") -> DataFrame:
    """Proportional allocation max(1, floor(share * n)); the largest class takes the remainder."""
    counts = stage(df.groupBy(by).agg(F.count(F.lit(1)).alias("_c")), "class-counts")  # read five times below
    totals = counts.agg(F.sum("_c").alias("t")).scalar()
    alloc = counts.withColumn("_t", totals).withColumn(
        "_a", F.greatest(F.lit(1), F.floor(F.col("_c") / F.col("_t") * n))
    )
    spare = alloc.agg((F.lit(n) - F.sum("_a")).alias("d")).scalar()
    largest = alloc.agg(F.min_by(by, F.struct(-F.col("_c"), F.col(by)))).scalar()
    alloc = alloc.withColumn("_spare", spare).withColumn("_top", largest)
    alloc = alloc.select(
        by,
        F.when(F.col("_t") <= n, F.col("_c"))
        .otherwise(F.col("_a") + F.when(F.col(by).eqNullSafe(F.col("_top")), F.col("_spare")).otherwise(F.lit(0)))
        .alias("_alloc"),
    )
    return hash_take(df, [by], lambda size: F.least(size, F.col("_alloc")), seed, id_col, extra=alloc)


def sample_per_group(df: DataFrame, by: str, cap: int, seed=42, id_col: str = "row_id") -> DataFrame:
    """At most ``cap`` rows of every group."""
    return hash_take(df, [by], lambda size: F.least(size, F.lit(cap)), seed, id_col)


def balanced_split(
    df: DataFrame, by: str, cap: int, frac: float = 0.7, seed=42, id_col: str = "row_id", name: str = "role"
) -> DataFrame:
    """Training rows: at most cap and at most a share of each group, at least one; the rest is held out."""
    ranked = hash_rank(df, [by], seed, id_col, "_rn", "_gs")
    quota = F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.col("_gs") * frac)))
    return ranked.withColumn(name, F.when(F.col("_rn") <= quota, "train").otherwise("holdout")).drop("_rn", "_gs")


def split_by_group(
    df: DataFrame, by: str, frac: float = 0.7, seed=42, id_col: str = "row_id", name: str = "role"
) -> DataFrame:
    """Stratified split: the rounded share of every group is training data."""
    ranked = hash_rank(df, [by], seed, id_col, "_rn", "_gs")
    return ranked.withColumn(
        name, F.when(F.col("_rn") <= F.bround(F.col("_gs") * frac), "train").otherwise("holdout")
    ).drop("_rn", "_gs")


def stratified_folds(df: DataFrame, by: str, k: int = 10, seed=42, id_col: str = "row_id") -> DataFrame:
    """Stratified k-fold: rows of each class are dealt to the folds in md5 order."""
    ranked = hash_rank(df, [by], seed, id_col, "_rn")
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def _time_block(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    # a literal: as a subquery the rows would be read for it again by every job on the result
    start = F.lit(df.agg(us(F.min(ts))).first()[0]).cast("long")
    return df.withColumn("_block", F.floor((us(F.col(ts)) - start) / F.lit(seconds * 1_000_000)).cast("long"))


def group_exec(
    df: DataFrame, ts: str = "ts", label: str = "label1", execution: str = "label_full", benign: str = "benign",
    seconds: int = 60,
) -> DataFrame:
    """Group id: the execution, or for benign rows the contiguous time block."""
    out = _time_block(df, ts, seconds)
    return out.withColumn(
        "grp",
        F.when(F.col(label) == benign, F.concat(F.lit("benign_block_"), F.col("_block").cast("string"))).otherwise(
            F.col(execution)
        ),
    ).drop("_block")


def group_device(df: DataFrame, device: str = "device_name") -> DataFrame:
    return df.withColumn("grp", F.col(device))


def group_time(df: DataFrame, ts: str = "ts", seconds: int = 300) -> DataFrame:
    return _time_block(df, ts, seconds).withColumn("grp", F.col("_block").cast("string")).drop("_block")


def deal_groups(groups: list[list[int]], totals: list[int], loads: list[list[int]]) -> list[int]:
    """Fold of every group, in the given order: the one whose class shares the group raises least unevenly.

    With shares s = count / total, giving group g to fold f adds 2 * sum(s_f * s_g) to the sum of squared shares besides
    a term that is the same for all folds. Integers (weights in thousandths) make the choice exact; among equals the fold
    with fewer rows, then the first one, is taken. `loads` are the class counts of the folds so far and grow.
    """
    most = max(totals, default=1)
    weight = [int(1000.0 * (most / t) * (most / t)) for t in totals]
    rows = [sum(load) for load in loads]
    out = []
    for g in groups:
        pull = [(c, n * weight[c]) for c, n in enumerate(g) if n]
        fold = min(range(len(loads)), key=lambda f: (sum(loads[f][c] * n for c, n in pull), rows[f], f))
        for c, n in enumerate(g):
            loads[fold][c] += n
        rows[fold] += sum(g)
        out.append(fold)
    return out


def stratified_group_folds(df: DataFrame, y: str, grp: str = "grp", k: int = 5, seed=42, most: int = 20_000) -> DataFrame:
    """Whole groups go to folds so that every class is spread evenly.

    Rows are reduced to one line of class counts per group. The `most` groups with the largest class shares are dealt
    one by one, largest first (see deal_groups). Smaller ones, if there are more, are dealt in parallel: those of one
    dominant class and size stand in md5 order and go to the folds in proportion to what each fold still lacks.
    """
    cells = stage(df.groupBy(grp, y).agg(F.count(F.lit(1)).alias("_c")), "group-cells")
    classes = [(r[0], r[1]) for r in cells.groupBy(y).agg(F.sum("_c").alias("t")).orderBy(F.col(y).asc_nulls_first()).collect()]
    totals = [t for _, t in classes]
    of = lambda c: F.sum(F.when(F.col(y).eqNullSafe(F.lit(c)), F.col("_c")).otherwise(0))
    groups = cells.groupBy(grp).agg(F.array(*[of(c) for c, _ in classes]).alias("_n"))
    share = F.aggregate(F.transform("_n", lambda n, i: (n * n).cast("double") / F.element_at(F.array(*[F.lit(float(t) * t) for t in totals]), i + 1)), F.lit(0.0), lambda a, v: a + v)
    groups = stage(groups.withColumn("_size", share).withColumn("_h", digest(seed, F.col(grp))), "groups")
    head = groups.orderBy(F.desc(F.round("_size", 12)), "_h", F.col(grp).asc_nulls_first()).limit(most).collect()
    loads = [[0] * len(classes) for _ in range(k)]
    folds = deal_groups([r["_n"] for r in head], totals, loads)
    kind = cells.schema[grp].dataType.simpleString()
    dealt = df.sparkSession.createDataFrame([(r[grp], f) for r, f in zip(head, folds, strict=True)], f"`{grp}` {kind}, fold int")
    if len(head) == most:
        last = head[-1]
        key = lambda size, h, g: F.struct(-F.round(size, 12), h, g)
        rest = groups.filter(key(F.col("_size"), F.col("_h"), F.col(grp)) > key(F.lit(last["_size"]), F.lit(last["_h"]), F.lit(last[grp])))
        like = [F.array_position("_n", F.array_max("_n")).alias("_dom"), F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n).alias("_rows")]
        ranked = hash_rank(rest.select(grp, "_n", *like), ["_dom", "_rows"], seed, grp, "_rn", "_of")
        # per class the bounds between the folds, in proportion to what each still lacks of an equal share
        lacking = [[max(0.0, t / k - load[c]) + 1e-9 for load in loads] for c, t in enumerate(totals)]
        bounds = F.array(*[F.array(*[F.lit(sum(row[: f + 1]) / sum(row)) for f in range(k - 1)]) for row in lacking])
        turn = F.pmod(F.xxhash64("_dom", "_rows"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        at = (F.col("_rn") - 0.5) / F.col("_of") + turn
        at = at - F.floor(at)
        fold = F.size(F.filter(F.element_at(bounds, F.col("_dom").cast("int")), lambda b: b <= at))
        dealt = dealt.unionByName(ranked.select(grp, fold.cast("int").alias("fold")))
    # written out first: the join then broadcasts the table only if its real size allows it,
    # and falls back to a sort-merge join whose hot groups are split at run time
    return null_safe_join(df, stage(dealt, "group-folds"), [grp])


def full_fold(df: DataFrame) -> DataFrame:
    """Descriptive protocol: one fold, every row is training data."""
    return df.withColumn("fold", F.lit(0)).withColumn("role", F.lit("train"))


def train_test(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Long table with one line per (row, evaluated fold) and its role."""
    return df.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "role", F.when(F.col(fold) == F.col("eval_fold"), "test").otherwise("train")
    )


def duplicate_overlap(df: DataFrame, features: list[str], protocols: dict[str, str]) -> DataFrame:
    """Share of test rows whose exact feature row also occurs in training, per fold protocol.

    ``protocols`` maps a protocol name to its fold column. Equal rows are counted once per
    fold by a partial aggregate; a test row has a twin in training exactly when its feature
    row occurs more often in the table than in its fold, so no fold is ever joined with its
    training part and a feature row shared by a third of the table costs one counter.
    """
    idle = F.lit(True)
    for f in features:
        idle = idle & F.coalesce(F.col(f) == 0, F.lit(False))
    names = list(protocols)
    slim = df.select(*features, *[F.col(c).alias(f"_f_{p}") for p, c in protocols.items()])
    combos = slim.groupBy(*features, *[f"_f_{p}" for p in names]).agg(F.count(F.lit(1)).alias("_c"))
    parts = combos.select(
        *features,
        "_c",
        F.inline(
            F.array(
                F.struct(F.lit("").alias("protocol"), F.lit(None).cast("int").alias("fold")),
                *[F.struct(F.lit(p).alias("protocol"), F.col(f"_f_{p}").cast("int").alias("fold")) for p in names],
            )
        ),
    )
    per_fold = parts.groupBy("protocol", "fold", *features).agg(F.sum("_c").alias("_n"))
    rows = per_fold.groupBy("protocol", *features).agg(
        F.sum("_n").alias("_all"), F.collect_list(F.struct("fold", "_n")).alias("_folds")
    )
    cells = rows.withColumn("_idle", idle).select("protocol", "_all", "_idle", F.inline("_folds"))
    whole = F.col("protocol") == ""
    twin = F.when(whole, F.col("_all") > 1).otherwise(F.col("_all") > F.col("_n"))
    shares = cells.groupBy("protocol", "fold").agg(
        (F.sum(F.when(twin, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("dup"),
        (F.sum(F.when(twin & ~F.col("_idle"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("nonidle"),
        (F.sum(F.when(F.col("_idle"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("idle"),
    )
    return shares.groupBy("protocol").agg(
        F.avg("dup").alias("dup_share_mean"),
        F.min("dup").alias("dup_share_min"),
        F.max("dup").alias("dup_share_max"),
        F.avg("nonidle").alias("nonidle_dup_share_mean"),
        F.max("nonidle").alias("nonidle_dup_share_max"),
        F.avg("idle").alias("idle_share"),
    ).withColumn("protocol", F.when(F.col("protocol") == "", "whole table").otherwise(F.col("protocol")))
