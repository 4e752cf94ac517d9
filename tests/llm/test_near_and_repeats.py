"""Joins and repeats against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from telesift.llm import near, repeats


def shingles(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent, postings = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in postings[x])
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for x in s:
            postings[x].append(i)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)].append(doc)
    return Counter((doc, len(sets[i]), min(least[find(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def check_components(df):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])


def test_query_matches_brute_force(spark, sf, docs):
    got = Counter(map(tuple, entry_points.queries()["op8_near_join"](spark, sf).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, empty):
    check_components(odd)
    assert near.components(empty).count() == 0
    kept = near.kept_documents(odd)
    assert kept.columns == odd.columns
    words = [r for r in kept.collect() if shingles(r.text)]
    assert not [1 for i, a in enumerate(words) for b in words[:i] if a.doc_id != b.doc_id and 100 * len(shingles(a.text) & shingles(b.text)) >= 80 * len(shingles(a.text) | shingles(b.text))]


def test_near_copies_among_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, and differ in text: each stands for its own text."""
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60 + g)]
        for j in range(3):
            text = " ".join([*base, *[f"more{j}"] * j])
            rows.append((None if g % 2 else 7 + j, text))
        if g % 4 == 1:
            rows.append((100 + g, " ".join([*base, "last"])))
    rows += [rows[3]] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(df)
    kept = [shingles(r.text) for r in near.kept_documents(df.dropDuplicates()).collect()]
    assert len(kept) == 12
    sf = df.select("doc_id", "text")
    wanted = sf.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("text").alias("class")).distinct()
    assert near.bodies(sf, wanted).count() == len(rows)


def test_every_pair_at_the_threshold_is_found(spark):
    """Sets around similarity 0.8 of many sizes, a large group of near copies, and a passage that all texts share."""
    rng, rows = random.Random(5), []
    passage = " ".join(f"p{i}" for i in range(60))
    for g in range(60):
        n = rng.choice([5, 6, 9, 13, 20, 45, 90, 200, 400])
        base = [f"g{g}w{i}" for i in range(n)]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                w[rng.randrange(n)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w + ([passage] if g % 2 else []))))
    base = [f"hot{i}" for i in range(120)]
    for _ in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"y{rng.random()}"
        rows.append((len(rows), " ".join(w)))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for n in (1, 2, 5, 8, 17, 50, 333, 2000):
        for _ in range(30):
            a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
            d = int(rng.integers(0, max(1, len(a) // 5) + 1))
            b = np.unique(np.r_[a[d:], rng.integers(1, 1 << 63, int(rng.integers(0, max(1, len(a) // 5) + 1)), dtype=np.uint64)])
            k = len(np.intersect1d(a, b))
            if len(b) and 100 * k >= 80 * (len(a) + len(b) - k):
                for common in (none, a[::2], a):
                    assert len(np.intersect1d(near.sketches(a, np.sort(common)), near.sketches(b, np.sort(common))))


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out[doc, len(t), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if t else 0, hashlib.sha256(kept).hexdigest()] += 1
    return out


def check_repeats(df, length, span):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats(df, length, span).collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in df.collect()], length)


def test_repeats_query_matches_brute_force(spark, sf, docs):
    got = Counter(map(tuple, entry_points.queries()["op10_repeats"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_repeats_in_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 4)
    short = odd.where("text is null or length(text) < 3000")
    check_repeats(short, 40, 20)
    assert repeats.repeats(empty).count() == 0
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdé ") for _ in range(130))
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 60) : rng.randint(70, 130)] + "z" * rng.randint(0, 50)) for i in range(80)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 20)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    part = rng.integers(97, 101, 3000).astype(np.uint8).tobytes()
    text = rng.integers(97, 101, 5000).astype(np.uint8).tobytes() + part + b"--" + part
    column = repeats.pa.array([text.decode()])
    whole = [x for s, d, o in repeats.pieces(column, 60) for x in covered(s, d, o)]
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = [x for s, d, o in repeats.pieces(column, 60) for x in covered(s, d, o)]
    assert sorted(whole) == sorted(cut) == list(range(len(text) - 59))


def covered(starts, data, offsets):
    text, first, windows, *_ = repeats.samples(data, offsets, 60, 30)
    return [int(starts[t] + f + i) for t, f, w in zip(text, first, windows, strict=True) for i in range(w)]


def test_word_hashes_of_long_texts(monkeypatch):
    texts = near.pa.array(["  aa Bb\tcc " * 50])
    a = next(near.shingle_sets(texts))
    monkeypatch.setattr(near, "PIECE", 40)
    assert (a == next(near.shingle_sets(texts))).all()
