"""k-means, assignment, Silhouette and agreement of labelings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from telesift.functions.exprs import log_hypergeometric, null_safe_join, xlogx
from telesift.functions.linalg import stack
from telesift.operators.neighbors import distances
from telesift.operators.sampling import sample_n
from telesift.session import cut_lineage, stage


# ---------------------------------------------------------------- fit and assign


def kmeans_fit(df: DataFrame, k: int, n_init: int = 5, seed: int = 42, vec: str = "v", max_iter: int | None = None, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """Best of n_init k-means fits by training cost; returns the k x d centres and the cost.

    The starts are Spark's (k-means||); the steps of all fits are taken in lock-step, one scan for all. A fit ends when no
    centre moves farther than `tol`, however many steps that takes; one that has not after `max_iter` steps, if given, is
    an error.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from telesift.operators.lockstep import Model, fit_many

    data = df.select(F.lit(0).alias("part"), vec).persist()
    try:
        features = data.select(array_to_vector(F.col(vec)).alias("features"))
        starts = [np.array(KMeans(k=k, seed=seed + i, maxIter=0).fit(features).clusterCenters()) for i in range(n_init)]
        models = [Model(0, np.ones(c.shape[1], bool), len(c), c, restart=i) for i, c in enumerate(starts)]
        fit_many(data, models, vec=vec, max_iter=max_iter, moved=tol)
    finally:
        data.unpersist()
    if not all(m.done for m in models):
        raise RuntimeError(f"k-means did not settle in {max_iter} steps")
    best = min(models, key=lambda m: m.cost)
    return best.centers, best.cost


def nearest_center(vec: str, centers: np.ndarray) -> Column:
    """Index of the nearest centre; the lowest index on ties."""
    c = np.asarray(centers, dtype=float)

    @F.pandas_udf(IntegerType())
    def nearest(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        return pd.Series(distances(stack(x), c).argmin(axis=1).astype("int32"))

    return nearest(F.col(vec))


def assign(df: DataFrame, centers: np.ndarray, vec: str = "v", name: str = "cluster") -> DataFrame:
    return df.withColumn(name, nearest_center(vec, centers))


def relabel_by_size(df: DataFrame, col: str = "cluster") -> DataFrame:
    """Cluster 0 is the largest; equal sizes keep their order."""
    sizes = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    order = sizes.select(col, (F.row_number().over(Window.orderBy(F.desc("_n"), col)) - 1).alias("_new"))
    out = null_safe_join(df, stage(order, "cluster-order"), [col])  # its real size decides how it is joined
    return out.withColumn(col, F.col("_new")).drop("_new")


def cluster_sizes(df: DataFrame, col: str = "cluster") -> DataFrame:
    sizes = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    share = F.col("n") / F.sum("n").over(whole)
    return sizes.withColumn("share", share).select(
        col, "n", "share", F.min("share").over(whole).alias("min_share"), F.max("share").over(whole).alias("max_share")
    )


# ---------------------------------------------------------------- Silhouette


def quick_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; fast, without exact zeros."""
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def row_silhouettes(x: np.ndarray, lab: np.ndarray, sample: np.ndarray, sample_lab: np.ndarray, metric=distances) -> np.ndarray:
    """Silhouette of rows that belong to the sample; 0 for rows alone in their cluster."""
    classes, counts = np.unique(sample_lab, return_counts=True)
    member = (sample_lab[:, None] == classes[None, :]).astype(float)
    total = metric(x, sample) @ member
    own = np.searchsorted(classes, lab)
    rows = np.arange(len(x))
    mine = counts[own]
    a = total[rows, own] / np.maximum(mine - 1, 1)
    other = total / counts
    other[rows, own] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    return np.where((mine > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)


def _sampled(df: DataFrame, n: int, seed, id_col: str, vec: str, label: str) -> pd.DataFrame:
    """The evaluation sample: at most n rows in md5 order, gathered once."""
    return sample_n(df.select(id_col, vec, label), n=n, seed=seed, id_col=id_col).toPandas().sort_values(id_col)


def _scored(df: DataFrame, local: pd.DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """(id, s): tasks share the bounded sample and turn each of its rows into one number."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    if not len(local):
        return spark.createDataFrame([], f"{id_col} {kind}, s double")
    x, lab = stack(local[vec]), local[label].to_numpy()
    shared = spark.sparkContext.broadcast((x, lab))
    ids = spark.createDataFrame(local[[id_col]].assign(_i=np.arange(len(local)))).repartition(spark.sparkContext.defaultParallelism)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, labels = shared.value
        for pdf in batches:
            if len(pdf):
                i = pdf["_i"].to_numpy()
                yield pd.DataFrame({id_col: pdf[id_col], "s": row_silhouettes(rows[i], labels[i], rows, labels)})

    return ids.mapInPandas(score, f"{id_col} {kind}, s double")


def silhouette_rows(df: DataFrame, n: int = 2000, seed=42, id_col: str = "row_id", vec: str = "v", label: str = "cluster") -> DataFrame:
    """Euclidean Silhouette of each row of a fixed md5 sample of at most n rows.

    The sample (n x d numbers, bounded by the parameter) is shared with the tasks, and no
    pair of rows is ever emitted.
    """
    return _scored(df, _sampled(df, n, seed, id_col, vec, label), id_col, vec, label)


def silhouette(df: DataFrame, n: int = 2000, seed=42, id_col: str = "row_id", vec: str = "v", label: str = "cluster") -> DataFrame:
    """Mean Silhouette of the sample; -1 when it holds fewer than two clusters."""
    local = _sampled(df, n, seed, id_col, vec, label)
    value = F.lit(-1.0) if local[label].nunique() < 2 else F.avg("s")
    return _scored(df, local, id_col, vec, label).agg(value.alias("silhouette"), F.count(F.lit(1)).alias("n_rows"))


def silhouette_full(df: DataFrame, vec: str = "v", label: str = "cluster") -> DataFrame:
    """Squared-Euclidean Silhouette of all rows in linear time; not comparable with `silhouette`."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col(vec)).alias("features"), F.col(label).cast("double").alias("prediction"))
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(data)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette_sq double")


def best_k(profile: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Number of clusters with the highest Silhouette; the lowest one on ties."""
    return profile.groupBy(*keys).agg(F.max_by("k", F.struct("sil", -F.col("k"))).alias("k_star"), F.max("sil").alias("sil"))


def profile_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("which", "k").agg(
        F.avg("sil").alias("sil_mean"), F.stddev_pop("sil").alias("sil_std"), F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- agreement of labelings


def contingency(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    x = n.cast("double")
    return x * (x - 1) / 2


def _margins(cont: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = cont.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    cols = cont.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    return rows, cols


KEY = "_key"


def _keyed(cont: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (cont, list(keys)) if keys else (cont.withColumn(KEY, F.lit(1)), [KEY])


def ari(cont: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Adjusted Rand index from contingency cells (keys, a, b, n)."""
    cont, ks = _keyed(cont, keys)
    rows, cols = _margins(cont, ks)
    cells = cont.groupBy(*ks).agg(F.sum(_pairs(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    ra = rows.groupBy(*ks).agg(F.sum(_pairs(F.col("na"))).alias("sa"))
    cb = cols.groupBy(*ks).agg(F.sum(_pairs(F.col("nb"))).alias("sb"))
    j = cells.join(ra, ks).join(cb, ks)
    expected = F.col("sa") * F.col("sb") / _pairs(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    same = (F.col("c") == F.col("sa")) & (F.col("c") == F.col("sb"))
    return j.select(*keys, F.when(same, F.lit(1.0)).otherwise((F.col("c") - expected) / (top - expected)).alias("ari"))


def _entropies(cont: DataFrame, ks: list[str]) -> DataFrame:
    """Per key: n, both entropies and the mutual information (natural logarithm)."""
    rows, cols = _margins(cont, ks)
    totals = cont.groupBy(*ks).agg(F.sum("n").alias("t"))
    h = lambda margin, c, name: margin.join(totals, ks).groupBy(*ks).agg((-F.sum(xlogx(F.col(c) / F.col("t")))).alias(name), F.count(F.lit(1)).alias(f"k_{name}"))
    cells = cont.filter("n > 0").join(rows, [*ks, "a"]).join(cols, [*ks, "b"]).join(totals, ks)
    p = F.col("n") / F.col("t")
    mi = cells.groupBy(*ks).agg(
        F.sum(p * (F.log(F.col("n").cast("double")) + F.log(F.col("t").cast("double")) - F.log(F.col("na").cast("double")) - F.log(F.col("nb").cast("double")))).alias("mi"),
        F.max("t").alias("t"),
    )
    return mi.join(h(rows, "na", "ha"), ks).join(h(cols, "nb", "hb"), ks)


def _expected_mi(cont: DataFrame, ks: list[str]) -> DataFrame:
    """Expected mutual information under random labelings with the same cluster sizes.

    Each pair of clusters contributes a hypergeometric sum over its possible overlaps. What lies more than 14 standard
    deviations and 30 counts off the mean is below the double precision of the result. From a deviation of 64 on the sum
    takes every s-th term s times, with 32 terms or more per deviation: for so smooth a law that is the same number, and
    a pair of clusters has at most about 1,900 terms whatever the number of rows. A cluster that holds all rows adds 0.
    """
    rows, cols = _margins(cont, ks)
    totals = cont.groupBy(*ks).agg(F.sum("n").alias("t"))
    grid = rows.join(cols, ks).join(totals, ks).filter("na < t and nb < t")
    a, b, t = (F.col(c).cast("double") for c in ("na", "nb", "t"))
    mean, spread = a / t * b, F.sqrt(a / t * (t - a) / t * b / (t - 1) * (t - b))
    stride = F.greatest(F.lit(1), F.floor(spread / 32)).cast("bigint")
    lo = F.greatest(F.lit(1.0), a + b - t, F.floor(mean - spread * 14 - 30)).cast("bigint")
    hi = F.least(a, b, F.ceil(mean + spread * 14 + 30)).cast("bigint")
    terms = grid.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_step", stride).filter("_lo <= _hi").withColumn("x", F.explode(F.sequence("_lo", "_hi", "_step")))
    x = F.col("x").cast("double")
    term = x / t * (F.log(x) + F.log(t) - F.log(a) - F.log(b)) * F.exp(log_hypergeometric(F.col("x"), F.col("na"), F.col("nb"), F.col("t")))
    return terms.groupBy(*ks).agg(F.sum(term * F.col("_step")).alias("emi"))


def ami(cont: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Adjusted mutual information with the arithmetic mean of the entropies."""
    cont, ks = _keyed(stage(cont, "contingency"), keys)  # read for every margin
    e = _entropies(cont, ks).join(_expected_mi(cont, ks), ks, "left")
    emi = F.coalesce("emi", F.lit(0.0))
    gap = (F.col("ha") + F.col("hb")) / 2 - emi
    eps = F.lit(2.220446049250313e-16)
    safe = F.when(gap < 0, F.least(gap, -eps)).otherwise(F.greatest(gap, eps))
    trivial = (F.col("k_ha") == 1) & (F.col("k_hb") == 1)
    return e.select(*keys, F.when(trivial, F.lit(1.0)).otherwise((F.col("mi") - emi) / safe).alias("ami"))


def nmi(cont: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies; 0 where that is 0."""
    cont, ks = _keyed(stage(cont, "contingency"), keys)
    mean = (F.col("ha") + F.col("hb")) / 2
    trivial = (F.col("k_ha") == 1) & (F.col("k_hb") == 1)
    return _entropies(cont, ks).select(
        *keys, F.when(trivial, F.lit(1.0)).when(mean > 0, F.col("mi") / mean).otherwise(F.lit(0.0)).alias("nmi")
    )


def best_matching(gain: np.ndarray) -> np.ndarray:
    """Row -> column assignment of a small square matrix with the largest total gain.

    Successive shortest augmenting paths with node prices, one row at a time.
    """
    n = len(gain)
    cost = gain.max() - gain.astype(float)
    price_r, price_c = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for r in range(n):
        reach = cost[r] - price_r[r] - price_c
        parent, done = np.full(n, r), np.zeros(n, bool)
        while True:
            c = int(np.where(done, np.inf, reach).argmin())
            done[c] = True
            if row_of[c] < 0:
                break
            i = row_of[c]
            through = reach[c] + cost[i] - price_r[i] - price_c
            better = ~done & (through < reach)
            reach[better], parent[better] = through[better], i
        end = reach[c]
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                price_r[row_of[j]] += end - reach[j]
            price_c[j] -= end - reach[j]
        price_r[r] += end
        while True:  # flip the path back to the start row
            i = parent[c]
            nxt = int(np.flatnonzero(row_of == i)[0]) if (row_of == i).any() else -1
            row_of[c] = i
            if i == r:
                break
            c = nxt
    out = np.full(n, -1)
    out[row_of] = np.arange(n)
    return out


def cluster_accuracy(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of rows on the best one-to-one matching of clusters and labels."""
    cells = contingency(df, cluster, label).toPandas()
    rows, cols = sorted(cells["a"].unique()), sorted(cells["b"].unique())
    n = max(len(rows), len(cols))
    table = np.zeros((n, n))
    for a, b, c in cells[["a", "b", "n"]].itertuples(index=False):
        table[rows.index(a), cols.index(b)] = c
    match = best_matching(table)
    hits = int(table[np.arange(n), match].sum())
    total = int(table.sum())
    return df.sparkSession.createDataFrame([(hits / total if total else None, hits, total)], "accuracy double, n_matched bigint, n_rows bigint")


def crosstab(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Cluster x label counts; labels in lexicographic order."""
    names = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    return df.groupBy(cluster).pivot(label, names).agg(F.count(F.lit(1))).na.fill(0)


def label_pairs(labels: DataFrame, keys: list[str], id_col: str = "row_id") -> DataFrame:
    """Contingency cells of every pair of pipelines, (p1, p2, a, b, n), keys of both sides beside.

    The few labels of one row are gathered and paired inside the row, and equal pairs are
    counted map-side; rows are never joined with themselves.
    """
    item = F.struct(F.col("pipeline"), F.col("lab"), *[F.col(k) for k in keys])
    rows = labels.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("ls"))
    left = rows.select(F.posexplode("ls").alias("i", "x"), "ls").withColumn(
        "y", F.explode(F.expr("slice(ls, i + 2, size(ls))"))
    )
    both = [f for k in keys for f in (F.col(f"x.{k}").alias(f"{k}_1"), F.col(f"y.{k}").alias(f"{k}_2"))]
    return left.select(F.col("x.pipeline").alias("p1"), F.col("y.pipeline").alias("p2"), *both, F.col("x.lab").alias("a"), F.col("y.lab").alias("b")).groupBy(
        "p1", "p2", *[f"{k}_{s}" for k in keys for s in (1, 2)], "a", "b"
    ).agg(F.count(F.lit(1)).alias("n"))


def pair_agreement(labels: DataFrame, keys: list[str] = (), id_col: str = "row_id") -> DataFrame:
    """ARI and AMI of every pair of pipelines on the same rows."""
    cells = cut_lineage(label_pairs(labels, list(keys), id_col))  # a few cells per pair, read several times
    on = ["p1", "p2", *[f"{k}_{s}" for k in keys for s in (1, 2)]]
    return ari(cells, on).join(ami(cells, on), on)


def cross_stability(labels: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Pairwise agreement with same_seed and same_k flags; k is a pipeline's number of labels."""
    ks = labels.groupBy("pipeline").agg(F.countDistinct("lab").alias("k"))
    pairs = pair_agreement(labels, ["seed"], id_col)
    k1, k2 = ks.toDF("p1", "k_a"), ks.toDF("p2", "k_b")
    out = pairs.join(k1, "p1").join(k2, "p2")
    return out.select(
        "p1", "p2", (F.col("seed_1") == F.col("seed_2")).alias("same_seed"), (F.col("k_a") == F.col("k_b")).alias("same_k"), "k_a", "k_b", "ari", "ami"
    )


def cross_stability_summary(pairs: DataFrame, by: list[str] = ("same_seed", "same_k")) -> DataFrame:
    by = list(by)
    stats = [F.avg("ari").alias("ari_mean"), F.stddev_samp("ari").alias("ari_std"), F.min("ari").alias("ari_min"),
             F.avg("ami").alias("ami_mean"), F.stddev_samp("ami").alias("ami_std"), F.min("ami").alias("ami_min"), F.count(F.lit(1)).alias("n_pairs")]
    return pairs.groupBy(*by).agg(*stats)


def resample_stability(
    df: DataFrame, k: int, b: int = 4, frac: float = 0.5, n_init: int = 5, seed: int = 42, id_col: str = "row_id", vec: str = "v",
) -> DataFrame:
    """Refit on b md5 resamples, label all rows with every fit, and compare the labelings.

    The fit on all rows (part 0) and the resamples advance in lock-step, so the whole
    experiment costs as many scans as one fit.
    """
    from telesift.functions.hashing import uniform
    from telesift.operators.lockstep import Model, fit_many, seed_many

    draws = [F.when(uniform(seed + 100 + i, F.col(id_col)) < frac, F.lit(i + 1)) for i in range(b)]
    parts = F.array_compact(F.array(F.lit(0), *draws))
    rows = df.select(id_col, vec, F.xxhash64(F.lit(seed), id_col).alias("row_hash"), F.explode(parts).alias("part")).persist()
    try:
        dim = df.agg(F.max(F.size(vec))).first()[0]
        present = [r.part for r in rows.select("part").distinct().collect()]
        models = [Model(p, np.ones(dim, bool), k, restart=r) for p in sorted(present) for r in range(n_init)]
        fit_many(rows, seed_many(rows, models, seed, vec=vec), vec=vec)
    finally:
        rows.unpersist()
    best = {p: min((m for m in models if m.part == p), key=lambda m: m.cost) for p in present}
    labeled = df.select(
        id_col,
        F.inline(
            F.array(*[F.struct(F.lit(f"fit{p}").alias("pipeline"), nearest_center(vec, m.centers).cast("bigint").alias("lab")) for p, m in best.items()])
        ),
    )
    return pair_agreement(labeled, [], id_col)


def agreement_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.avg("ari").alias("ari_mean"), F.min("ari").alias("ari_min"), F.avg("ami").alias("ami_mean"), F.min("ami").alias("ami_min"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
