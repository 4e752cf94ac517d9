"""Forest proxy of a clustering, its attributions, and the tables read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telesift.functions.exprs import xlogx
from telesift.operators.evaluate import FEATURES, LABEL, clf_rf, confusion, fidelity
from telesift.operators.sampling import balanced_split, sample_per_group
from telesift.operators.treeshap import TreeTable, attributions, base_of, tree_tables
from telesift.session import scratch_path


def fit_proxy(df: DataFrame, features: list[str], cluster: str = "cluster", trees: int = 200, depth: int = 10, seed: int = 42):
    """Forest that predicts the cluster from the selected features."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol=FEATURES).transform(df).withColumn(LABEL, F.col(cluster).cast("double"))
    return clf_rf(trees, depth, seed, 32).fit(rows.select(FEATURES, LABEL))


def proxy_predictions(model, df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol=FEATURES).transform(df)
    keep = [c for c in df.columns if c not in features]
    return model.transform(rows).select(*keep, F.col(cluster).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))


def proxy_split(df: DataFrame, k: int, cluster: str = "cluster", budget: int = 5000, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Balanced training rows (budget // k per cluster, at most 70 %) and the hold-out."""
    return balanced_split(df, cluster, max(1, budget // k), 0.7, seed, id_col)


def proxy_fidelity(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 per split from given predictions."""
    return fidelity(confusion(pred, keys), keys)


# ---------------------------------------------------------------- forest attributions


def forest_nodes(model) -> DataFrame:
    """The node table of a fitted forest, as Spark stores it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    n = lambda c: F.col(f"nodeData.{c}")
    return nodes.select(
        F.col("treeID").alias("tree"), n("id").alias("node"), n("leftChild").alias("left"), n("rightChild").alias("right"),
        n("split.featureIndex").alias("feature"), F.get(n("split.leftCategoriesOrThreshold"), 0).alias("cut"),
        n("impurityStats").alias("stats"),
    )


def forest_trees(model) -> list[TreeTable]:
    """The fitted forest as level tables; its size is bounded by trees x depth, not by rows."""
    return tree_tables(forest_nodes(model).toPandas())


def tree_shap(df: DataFrame, model, features: list[str], id_col: str = "row_id", keep: list[str] = ()) -> DataFrame:
    """Attributions (id, keep.., cluster, phi) of a forest's class probabilities, phi an array over the features.

    The forest is shared with the tasks; rows stay distributed. Per row and cluster the attributions and the base
    value sum to the probability.
    """
    return attributions(df, forest_trees(model), features, id_col, list(keep))


def by_feature(phi: DataFrame) -> DataFrame:
    """The array rows of tree_shap as (.., pos, phi), for the tables below."""
    return phi.select(*[c for c in phi.columns if c != "phi"], F.posexplode("phi").alias("pos", "phi"))


def base_values(model) -> list[float]:
    """Expected class probabilities of the forest over its training cover."""
    return [float(v) for v in base_of(forest_trees(model))]


def explained(split: DataFrame, per_cluster: int = 300, cluster: str = "cluster", seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """The held-out rows to explain: at most `per_cluster` of each cluster."""
    return sample_per_group(split.filter("role = 'holdout'"), cluster, per_cluster, seed, id_col)


# ---------------------------------------------------------------- tables over attributions


def cluster_profile(phi: DataFrame) -> DataFrame:
    """Mean |phi| per feature over the cluster's own rows; 0 for a cluster without rows."""
    own = F.when(F.col("row_cluster") == F.col("cluster"), F.abs("phi"))
    return phi.groupBy("cluster", "pos").agg(F.coalesce(F.avg(own), F.lit(0.0)).alias("value"))


def cluster_importance(phi: DataFrame) -> DataFrame:
    """Mean |phi| per feature and cluster over all rows."""
    return phi.groupBy("cluster", "pos").agg(F.avg(F.abs("phi")).alias("value"))


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean |phi| per feature over rows and clusters, ranked."""
    imp = phi.groupBy("pos").agg(F.avg(F.abs("phi")).alias("value"))
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "pos")))


def group_importance(gi: DataFrame, groups: DataFrame, selected: DataFrame) -> DataFrame:
    """Importance per feature group with its selected and total features; unmapped ones are "Unknown"."""
    joined = gi.join(F.broadcast(groups.select("pos", "grp")), "pos", "full").join(
        F.broadcast(selected.select("pos", F.lit(1).alias("_s"))), "pos", "left"
    )
    return joined.groupBy(F.coalesce("grp", F.lit("Unknown")).alias("grp")).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        F.count("_s").alias("n_selected"),
        F.count(F.lit(1)).alias("n_features"),
    )


def _ranked(profile: DataFrame) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy(F.desc("value"), "pos")
    whole = Window.partitionBy("cluster")
    total = F.sum("value").over(whole)
    return profile.withColumn("rn", F.row_number().over(order)).withColumn(
        "share", F.when(total > 0, F.col("value") / total).otherwise(F.col("value"))
    )


def clarity(profile: DataFrame, features: DataFrame, f1: DataFrame, rows: DataFrame, benign: str = "benign") -> DataFrame:
    """Clarity of each cluster: concentration of its profile times the proxy's F1, with its labels.

    ``f1`` holds (cluster, precision, recall, f1), ``rows`` (cluster, label1, label2).
    """
    ranked = _ranked(profile).join(F.broadcast(features), "pos")
    nth = lambda i, c: F.max(F.when(F.col("rn") == i, F.col(c)))
    shape = ranked.groupBy("cluster").agg(
        F.sum(F.when(F.col("rn") <= 3, F.col("share")).otherwise(0.0)).alias("top3_share"),
        F.exp(-F.sum(xlogx(F.col("share")))).alias("n_eff"),
        nth(1, "share").alias("top1_share"),
        *[nth(i, "feature").alias(f"top{i}") for i in (1, 2, 3)],
    )
    votes = ranked.filter("rn <= 5").groupBy("cluster", "grp").agg(F.count(F.lit(1)).alias("c"), F.min("rn").alias("first"))
    group = votes.groupBy("cluster").agg(
        F.min_by("grp", F.struct(-F.col("c"), F.col("first"))).alias("dominant_group"), F.max("c").alias("dominant_group_top5")
    )
    # per cluster and label pair first, then per cluster: a large cluster never sits in one task
    cells = rows.groupBy("cluster", "label1", "label2").agg(F.count(F.lit(1)).alias("c"))
    size = cells.groupBy("cluster").agg(
        F.sum("c").alias("n_rows"), (F.sum(F.when(F.col("label1") == benign, F.col("c")).otherwise(0)) / F.sum("c")).alias("benign_share")
    )
    by_label = cells.groupBy("cluster", "label2").agg(F.sum("c").alias("c"))
    label = by_label.groupBy("cluster").agg(
        F.min_by("label2", F.struct(-F.col("c"), F.col("label2"))).alias("dominant_label"), (F.max("c") / F.sum("c")).alias("dominant_label_share")
    )
    out = shape.join(group, "cluster").join(size, "cluster").join(label, "cluster").join(f1, "cluster", "left")
    out = out.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy())).withColumn(
        "clarity_index", F.coalesce("f1", F.lit(0.0)) * F.col("top3_share")
    )
    return out.withColumn("clarity_rank", F.row_number().over(Window.orderBy(F.desc("clarity_index"), "cluster")))


def top_features(imp: DataFrame, selected: DataFrame, n: int) -> DataFrame:
    """The n most important features of each cluster, flagged if selected."""
    top = _ranked(imp).filter(F.col("rn") <= n)
    return top.join(F.broadcast(selected.select("pos", F.lit(True).alias("_s"))), "pos", "left").select(
        "cluster", F.col("rn").alias("rank"), "pos", "value", F.coalesce("_s", F.lit(False)).alias("selected")
    )


def top_overlap(gi: DataFrame, selected: DataFrame, n: int = 10) -> DataFrame:
    """How many of the globally top n features are selected."""
    hit = gi.filter(F.col("rank") <= n).join(F.broadcast(selected.select("pos", F.lit(1).alias("_s"))), "pos", "left")
    return hit.agg(F.count("_s").alias("n_selected"), F.sum(F.col("_s").isNull().cast("long")).alias("n_not_selected"))


def dominant_groups(imp: DataFrame, features: DataFrame, n: int = 3) -> DataFrame:
    """Distinct groups of a cluster's top features, most important first."""
    top = _ranked(imp).filter(F.col("rn") <= n).join(F.broadcast(features), "pos", "left")
    ordered = F.sort_array(F.collect_list(F.struct("rn", F.coalesce("grp", F.lit("Unknown")).alias("grp"), "feature")))
    return top.groupBy("cluster").agg(ordered.alias("o")).select(
        "cluster",
        F.array_join(F.array_distinct(F.transform("o", lambda s: s["grp"])), ",").alias("groups"),
        F.array_join(F.transform("o", lambda s: s["feature"]), ",").alias("features"),
    )


def representative(phi: DataFrame) -> DataFrame:
    """The row of each cluster with the largest total |phi| for it."""
    own = phi.filter(F.col("row_cluster") == F.col("cluster"))
    rows = own.groupBy("cluster", "row_id").agg(F.sum(F.abs("phi")).alias("total"))
    return rows.groupBy("cluster").agg(F.max_by("row_id", F.struct("total", -F.col("row_id"))).alias("row_id"), F.max("total").alias("total"))


def profile_matrix(profile: DataFrame, features: DataFrame, clusters: list[int], n: int = 22) -> DataFrame:
    """Column-normalised profile of the n features with the largest share in any cluster."""
    shares = _ranked(profile).groupBy("pos").agg(
        F.max("share").alias("peak"), *[F.max(F.when(F.col("cluster") == c, F.col("share"))).alias(f"c{c}") for c in clusters]
    )
    top = shares.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("peak"), "pos"))).filter(F.col("rank") <= n)
    return top.join(F.broadcast(features), "pos").select("rank", "pos", "feature", "grp", *[f"c{c}" for c in clusters])
