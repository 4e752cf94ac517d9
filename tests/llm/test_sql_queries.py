"""Queries that SQL can express, and the edge cases of their operators (DataFrame operations only)."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry_points
from check import compare
from telesift.llm import exact, mixing


@pytest.mark.parametrize("name", ["op3_mixing", "op5_exact_dedup"])
def test_matches_oracle(spark, con, sf, name):
    ok, note = compare(spark, con, name, sf)
    assert ok, note


def test_thirteen_queries_and_the_pipeline_are_registered():
    names = set(entry_points.queries())
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in names


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_targets_on_odd_rows(odd):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    total, by = sum(r["size"] for r in found), defaultdict(list)
    for r in found:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    assert sorted(r["size"] for r in found) == sorted(count(r.text) for r in odd.collect())
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0].source_size == sum(r["size"] for r in v)
        assert sum(r.taken for r in v) == int(v[0].target)
    assert sorted(map(tuple, mixing.mix(odd.repartition(5)).select("doc_id", "taken").collect()), key=str) == sorted(((r.doc_id, r.taken) for r in found), key=str)


def test_water_filling_clamps_and_redistributes(spark):
    t = spark.createDataFrame([(10, 3.0), (100, 1.0), (100, 2.0), (1, 5.0)], "source_size long, weight double")
    got = {(r.source_size, r.weight): r.target for r in mixing.water_fill(t, 1.5 * 211, 2.0).collect()}
    left = 316.5 - 20 - 2
    assert got[10, 3.0] == 20 and got[1, 5.0] == 2
    assert got[100, 2.0] == pytest.approx(min(200, left * 2 / 3)) and got[100, 1.0] == pytest.approx(left - got[100, 2.0])


def test_mixed_documents_hold_the_words_taken(odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += count(r.text)
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.taken
    for k in want:
        assert abs(got[k] - want[k]) <= 1, k  # repeated rows share their sum


def test_mix_of_an_empty_table(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_chunks_make_up_the_text(odd):
    for r in odd.select("text", exact.chunks(exact.F.coalesce("text", exact.F.lit(""))).alias("c")).collect():
        assert "".join(r.c) == (r.text or "")
        assert all(len(x) <= exact.MOST_CHUNK for x in r.c)


def test_duplicates_of_odd_rows(odd):
    groups = defaultdict(list)
    for r in odd.collect():
        groups[r.text or ""].append(r.doc_id)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.duplicates(odd).collect())
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert got == want


def test_one_row_of_each_text_stays(odd, empty):
    kept = exact.kept_documents(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in odd.collect()}
    assert exact.kept_documents(empty).count() == 0


def test_chunks_that_share_a_hash_stay_apart(spark, monkeypatch):
    same = exact.F.lit(7).cast("long")
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: same)
    t = spark.createDataFrame([(1, "one text"), (2, "another text"), (3, "one text")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.duplicates(t).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2)}
