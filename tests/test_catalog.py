"""Registered queries against their oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check import compare

QUICK = [
    "flagship_top_features", "scan_csv", "scan_pruned", "load_dataset", "groups_from_prefix", "scan_runs", "eval_long", "resolve_names",
    "union_results", "column_presence", "type_census", "label_distribution", "quality_counts", "zero_variance", "group_mapping",
    "dataset_summary", "idle_rows", "encode_labels", "fit_scaler_training", "apply_scaler", "clean_and_scale", "sample_n", "sample_frac",
    "sample_stratified", "sample_per_group", "balanced_split", "split_by_group", "stratified_folds", "stratified_group_folds",
    "duplicate_overlap", "two_views", "legacy_views", "vicreg_terms", "encode_masked", "collapse_check", "relabel_by_size", "silhouette",
    "silhouette_full", "best_k", "ami", "cross_stability", "path_subsets", "complete_ranking", "knn_graph", "rank_laplacian", "rank_spec",
    "k_sweep", "metrics", "fidelity", "clf_knn", "eval_plan", "experiment_grid", "clarity", "profile_matrix", "consensus", "group_coverage",
    "selection_frequency", "jaccard_summary", "nogueira", "tost", "compare", "natural_points", "multiseed_pooled", "budget_delta",
    "per_class_table", "extras_summary", "ablation_table", "ablation_paired", "ablation_selection", "step_deltas", "k_sweep_curve",
    "often_removed", "cross_dataset", "seeds_table", "cluster_accuracy", "kmeans_fit_check", "clf_dt_margins", "tree_shap_sums", "smooth_eigenvectors",
    "run_chain",
]


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUICK) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_matches_oracle(spark, con, sf, name):
    ok, note = compare(spark, con, name, sf)
    assert ok, note


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["eval_fold", "rank", "pos", "feature", "score"]
    assert df.count() == 25
