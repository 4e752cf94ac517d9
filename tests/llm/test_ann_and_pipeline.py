"""Recall of the graph search against brute force, and the pipeline against a plain version of its stages."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_near_and_repeats import brute_components
from test_pages_files_packing import check_pieces

import corpus_pipeline
from telesift.llm import ann, mixing, toxicity
from telesift.llm.registry import QUERIES


def brute_nearest(ids, vectors, queries, k=20):
    out = {}
    for q in queries:
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]
        out[ids[q]] = ids[best].tolist(), scores[best]
    return out


def recall(found, ids, vectors, queries, k=20):
    got = defaultdict(list)
    for r in found:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want, hit, all_ = brute_nearest(ids, vectors, queries, k), 0, 0
    assert set(got) == set(want)
    place = {v: i for i, v in enumerate(ids)}
    for q, (near, _) in want.items():
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, len(near) + 1))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert q not in [r[1] for r in rows]
        assert np.allclose([s for _, _, s in rows], [vectors[place[v]] @ vectors[place[q]] for _, v, _ in rows], rtol=0, atol=1e-12)
        hit, all_ = hit + len(set(near) & {r[1] for r in rows}), all_ + len(near)
    return hit / all_


def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert recall(QUERIES["op1_ann"](spark, sf).collect(), ids, vectors, np.flatnonzero(ids % 20 == 0)) >= 0.97


def test_recall_with_unequal_norms_and_many_copies(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(3000, 12)) * rng.uniform(0.2, 3.0, (3000, 1))
    vectors[1000:2000] = vectors[17]  # a third of all rows
    t = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, code string")
    found = ann.nearest(t, t.where("vec_id % 50 = 0"))
    assert recall(found.collect(), np.arange(3000), vectors, np.arange(0, 3000, 50)) >= 0.9


def test_recall_in_tight_clusters_and_with_far_apart_norms(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    tight = centres[rng.integers(0, 20, 1500)] + 0.01 * rng.normal(size=(1500, 16))
    tailed = rng.normal(size=(1500, 16)) * np.exp(2 * rng.normal(size=(1500, 1)))
    tailed /= np.abs(tailed).max()
    for vectors in (tight, tailed):
        t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        found = ann.nearest(t, t.where("vec_id % 20 = 0"))
        assert recall(found.collect(), np.arange(1500), vectors, np.arange(0, 1500, 20)) >= 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(t, t.select("vec_id")).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 8, 0.5), (1, 1, 0, 0.5), (1, 2, 8, 0.5), (8, 1, 0, 0.5), (8, 2, 1, 0.5)]
    assert ann.nearest(t.limit(0), t.limit(0)).count() == 0
    assert ann.nearest(t.where("vec_id = 0"), t.where("vec_id = 0")).count() == 0


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_pipeline_matches_a_plain_version(spark, sf):
    """Every stage on its own input, against plain Python; the last rows hold exactly the words of the mix."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    docs = read("documents")
    columns = docs.columns
    bad = {r.doc_id for r in toxicity.toxicity(docs, read("labels")).collect() if r.predicted}
    left = [r for r in docs.collect() if r.doc_id not in bad]
    last = {}
    for r in left:
        last[r.text or ""] = max(r, last.get(r.text or "", r), key=lambda x: x.doc_id)
    left = list(last.values())
    component = {doc: c for doc, _, c in brute_components([(r.doc_id, r.text) for r in left])}
    left = [r for r in left if component[r.doc_id] == r.doc_id]
    stage = docs
    for name, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, sf).checkpoint() if spark.sparkContext.getCheckpointDir() else f(spark, stage, sf)
        assert stage.columns == columns, name
    assert {r.doc_id for r in stage.collect()} == {r.doc_id for r in left}
    mixed = mixing.mixed(spark.createDataFrame(left, docs.schema)).collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert sum(words.values()) > 0
    pieces = corpus_pipeline.run(spark, sf).collect()
    check_pieces([(r.doc_id, r.text) for r in mixed], pieces)
    assert public_tokenizers.path("word_bpe_49k.json")


LABELS = "doc_id long, quality int, toxic int, text string"


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass through all stages."""
    sf = str(tmp_path)
    odd.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0, "x"), (1, None, 1, "x"), (None, 1, 1, "x"), (7, 1, None, None), (99, 0, 1, "")], LABELS).write.parquet(f"{sf}/labels.parquet")
    stage, rows = spark.read.parquet(f"{sf}/documents.parquet"), [r.asDict() for r in odd.collect()]
    for i, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        f(spark, stage, sf).write.parquet(f"{sf}/stage{i}")
        stage = spark.read.parquet(f"{sf}/stage{i}")
        assert stage.columns == odd.columns, name
        kept = [r.asDict() for r in stage.collect()]
        if i == 0:
            texts = {r["text"] or "" for r in kept}
            rows = [r for r in rows if (r["text"] or "") in texts]
        if i == 1:
            assert sorted(r["text"] or "" for r in kept) == sorted({r["text"] or "" for r in rows})
            for r in kept:
                alike = [x["doc_id"] for x in rows if (x["text"] or "") == (r["text"] or "") and x["doc_id"] is not None]
                assert r["doc_id"] == max(alike, default=None)
        if i == 2:
            want = brute_components([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in kept} == {c for _, _, c in want}
        before = kept
    pieces = corpus_pipeline.run(spark, sf).collect()
    check_pieces([(r["doc_id"], r["text"]) for r in before], pieces)


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    sf = str(tmp_path)
    empty.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_no_table_of_the_search_is_broadcast(spark, monkeypatch):
    """However small Spark takes a table with lists to be, it is joined by sorting."""
    plans, kept = [], ann.staged
    monkeypatch.setattr(ann, "staged", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or kept(df, name))
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)))], "vec_id long, embedding array<double>")
    out = ann.nearest(rows, rows.where("vec_id % 30 = 0"), 5)
    plans.append(("result", out._jdf.queryExecution().sparkPlan().toString()))
    assert out.count() == 50 and {"ann-graph", "ann-state", "ann-queries", "result"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoop" in plan]
