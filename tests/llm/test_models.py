"""Language and toxicity: exact parts against brute force, the rest by held-out accuracy; edge cases."""

import math
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry_points
from telesift.llm import language, toxicity

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    lattice, prob = language.Lattice(pieces), np.random.default_rng(1).random((len(pieces) + 1, 2))
    prob[-1] = 0

    def total(word, lang):
        text = "▁" + word

        @lru_cache(None)
        def rest(i):
            if i == len(text):
                return 1.0
            return language.FLOOR * rest(i + 1) + sum(prob[j, lang] * rest(i + len(p)) for j, p in enumerate(pieces) if text.startswith(p, i))

        return rest(0)

    words = ["ab", "aab", "c", "abba", "a", "babab", "é"]
    got = lattice.log_likelihood(prob, words)
    assert np.allclose(got, [[math.log(total(w, 0)), math.log(total(w, 1))] for w in words])


def test_expected_counts_are_the_gradient():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    lattice, rng = language.Lattice(pieces), np.random.default_rng(2)
    prob = rng.random((len(pieces) + 1, 2))
    prob[-1] = 0
    words, counts = ["ab", "abab", "ba"], rng.random((3, 2))
    got = lattice.expected(prob, words, counts)
    for j in range(len(pieces)):
        more = prob.copy()
        more[j] *= 1 + 1e-6
        slope = ((lattice.log_likelihood(more, words) - lattice.log_likelihood(prob, words)) * counts).sum(axis=0) / 1e-6
        assert np.allclose(got[j], slope, rtol=1e-3, atol=1e-6)


def test_held_out_languages(spark, sf, docs):
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = entry_points.queries()["op2_language"](spark, sf).collect()
    assert len(found) == len(lang) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, odd, empty, docs):
    model = language.fit(docs.select("doc_id", "text", "lang"), VOCABULARY, most_docs=100, rounds=1)
    out = language.predict(odd, model)
    got = out.collect()
    assert len(got) == odd.count() and set(odd.columns) - {"text", "score"} < set(out.columns)
    for r in got:
        assert (r.lang_pred == "und") == (r.score == 0.0)
    blank = {r.doc_id for r in odd.collect() if not language.words_of(r.text)}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == blank
    assert language.predict(empty, model).count() == 0
    none = language.fit(empty.select("doc_id", "text", "lang"), VOCABULARY)
    assert {r.lang_pred for r in language.predict(odd.select("doc_id", "text"), none).collect()} == {"und"}


def test_block_maxima_give_the_exact_nearest():
    rng = np.random.default_rng(5)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    dense[dense.sum(axis=1) == 0, 0] = 1
    dense[200:220] = dense[0]  # ties
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows, cols = np.nonzero(dense)
    index = toxicity.Index(np.arange(300), np.zeros(300, int), rows, cols, dense[rows, cols], 40, block=16)
    for q in dense[::7]:
        at = np.flatnonzero(q)
        got, cosines = index.nearest(at, q[at], 15)
        scores = np.round(dense @ q, 12)
        want = [i for i in np.lexsort((np.arange(300), -scores)) if scores[i] > 0][:15]
        assert np.allclose(cosines, scores[want]) and np.allclose(np.sort(scores[got]), np.sort(scores[want]))


def test_monotone_fit():
    x, y = np.array([0.0, 0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0])
    at, rate = toxicity.monotone(x, y, np.ones(5))
    assert (np.diff(rate) >= 0).all() and (np.diff(at) >= 0).all() and rate[0] < 0.5 < rate[-1]


def test_planted_toxicity(spark):
    """Insults of a made-up stock in a tenth of the texts; the labels teach, a fifth is held out."""
    rng = np.random.default_rng(6)
    stock, bad = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}en" for i in range(400)], ["qumbolt", "zorfgranz", "plixnorr"]
    rows, labels = [], []
    for i in range(1500):
        words = list(rng.choice(stock, 60))
        toxic = int(i % 10 == 0)
        if toxic:
            for w in rng.choice(bad, 3):
                words[int(rng.integers(60))] = w + str(rng.choice(["", "en", "er"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    t, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(t, y).collect()
    wrong = [r for r in out if r.predicted != int(r.doc_id % 10 == 0)]
    assert len(out) == 1500 and any(r.held_out for r in out) and len(wrong) <= 8
    assert all(r.evidence for r in out if r.predicted)
    kept = {r.doc_id for r in toxicity.kept_documents(t, y).collect()}
    assert kept == {r.doc_id for r in out if not r.predicted}


def test_rare_and_few_toxic_words_are_terms(spark):
    """Every insult is in three labelled texts only, and there are fewer labelled texts than any count or chi-squared bound could ask for."""
    rng = np.random.default_rng(8)
    stock = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}en" for i in range(40)]
    bad = ["qumbolt", "zorfgranz", "plixnorr", "drevskuhl", "hjafnyst"]
    rows, labels = [], []
    for i in range(60):
        toxic = int(i % 4 == 0)
        rows.append((i, " ".join([*rng.choice(stock, 8), *([bad[(i // 4) % 5]] * 3 if toxic else [])])))
        labels.append((i, toxic))
    t, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(t, y).collect()
    assert all(r.evidence for r in out)
    assert sum(r.predicted != int(r.doc_id % 4 == 0) for r in out) <= 2
    examples, _ = toxicity.sample_examples(t, y)
    features, tells = toxicity.select_features(examples)
    assert set(features) == set().union(*(toxicity.grams(toxicity.plain(x)) for _, x in rows)) and (tells > 0).all()


def test_toxicity_of_odd_rows(spark, sf, odd, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0)], "doc_id long, toxic int"))
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.kept_documents(odd, labels.limit(0)).columns == odd.columns


@pytest.mark.parametrize("name", ["op9_toxicity"])
def test_query_covers_all_documents(spark, sf, docs, name):
    out = entry_points.queries()[name](spark, sf)
    assert {"doc_id", "held_out", "score", "predicted"} <= set(out.columns)
    assert out.count() == docs.count()


def test_groups_of_examples_share_no_matrix():
    """Two vocabularies: usual terms of one are not multiplied with examples of the other, and the nearest stay exact."""
    rng = np.random.default_rng(9)
    counts = np.zeros((400, 120), int)
    for i in range(400):
        counts[i, 60 * (i % 2) + rng.choice(60, 20, replace=False)] = rng.integers(1, 4, 20)
    counts[300:320] = counts[0]  # ties
    weight = rng.random(120) + 0.5
    terms = [toxicity.packed_terms(np.flatnonzero(c), c[c > 0]) for c in counts]
    model = toxicity.Model(weight, np.arange(400), np.zeros(400, int), terms, (np.array([0.0, 1.0]), np.array([0.0, 1.0])), 0.0)
    index = model.index
    assert sum(d.size for d in index.dense) <= 0.6 * 120 * 400 and index.values.itemsize == 1
    vectors = [toxicity.unit(*toxicity.unpacked(t), weight) for t in terms]
    dense = np.zeros((400, 120))
    for i, (c, v) in enumerate(vectors):
        dense[i, c] = v
    for i, (got, cosines) in enumerate(index.nearest_of(vectors, 15, list(range(400)))):
        scores = np.round(dense @ dense[i], 12)
        scores[i] = 0
        want = [j for j in np.lexsort((np.arange(400), -scores)) if scores[j] > 0][:15]
        assert i not in got and np.allclose(cosines, scores[want]) and np.allclose(np.sort(scores[got]), np.sort(scores[want]))


def test_looked_up_terms_are_the_n_grams_of_plain_texts(monkeypatch):
    """Letters of any plane, short words, digits and runs of blanks; counts are those of the plain text."""
    rng = np.random.default_rng(10)
    texts = [None, "", " \n", "1 2", "a", "A b", "ab_ab", "aaaaaaaaaa a aa", "日本語 テキス 日本語x", "𐐀𐐁𐐂 𐐀", "İstanbul ΟΔΟΣ", *("".join(rng.choice(list("ab zBİ日Σ𐐁1-\t"), 200)) for _ in range(60))]
    known = sorted(set().union(*(toxicity.grams(toxicity.plain(t)) for t in texts[::2])))
    table = toxicity.Grams(known)
    for windows in (toxicity.WINDOWS, 7):
        monkeypatch.setattr(toxicity, "WINDOWS", windows)
        for text, terms in zip(texts, table.counted(texts), strict=True):
            text = toxicity.plain(text)
            want = {i: sum(text.startswith(g, at) for at in range(len(text))) for i, g in enumerate(known) if g in text}
            cols, counts = toxicity.unpacked(terms)
            assert dict(zip(cols.tolist(), counts.tolist(), strict=True)) == want
    assert [len(toxicity.unpacked(t)[0]) for t in toxicity.Grams([]).counted(["a", None])] == [0, 0]


def test_index_is_shared_by_all_jobs(spark):
    """Votes and scores read one broadcast: a worker never holds two indexes."""
    terms = [toxicity.packed_terms(np.array([i % 3, 3 + i % 2]), np.array([1, 2])) for i in range(12)]
    model = toxicity.Model(np.ones(5), np.arange(12), np.arange(12) % 2, terms, (np.array([0.0, 1.0]), np.array([0.0, 1.0])), 0.0)
    votes = toxicity.own_votes(spark, model)
    held = model.held
    model.curve, model.empty = (np.array([0.0, 1.0]), np.array([0.25, 0.75])), 0.125
    counted = spark.createDataFrame([(0, bytearray(terms[0])), (1, bytearray(toxicity.packed_terms(np.zeros(0, np.int64), np.zeros(0, np.int64))))], "doc_id long, terms binary")
    got = {r.doc_id: r.score for r in toxicity.score(counted, model).collect()}
    assert model.held is held and len(votes) == 12 and got[1] == 0.125 and 0.25 <= got[0] <= 0.75


def test_all_labelled_texts_are_examples(spark, monkeypatch):
    """More labels than any former bound, and the same scores whether the examples lie in one part or in many."""
    rows = [(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}en {'qumbolt' if i % 3 == 0 else 'feld'}") for i in range(13_000)]
    t, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    examples, totals = toxicity.sample_examples(t, y)
    assert examples.count() == 13_000 and totals == {1: 4334, 0: 8666}
    some, few = t.where("doc_id < 400"), y.where("doc_id < 400")
    got = []
    for part in (toxicity.PART, 64):
        monkeypatch.setattr(toxicity, "PART", part)
        got.append(sorted(map(str, toxicity.toxicity(some, few).collect())))
    assert got[0] == got[1] and len(got[0]) == 400
