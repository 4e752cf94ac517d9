"""Removal of long byte strings that occur more than once anywhere in the corpus.

Every string of `length` bytes (a window) is sorted under one sampled suffix: the suffix that starts at the smallest
hash among the window's first positions, so equal windows have equal samples wherever they stand. A sample carries the
hash of its first bytes (its key) and of all bytes that its run of windows covers. Spark sorts and groups the samples
instead of all suffixes, about one in 128 positions:

* samples of equal key and equal run: every window of the run repeats; nothing else has to be read;
* samples of equal key, but unlike runs (near the ends of repeated passages): the order of the windows is induced from
  their samples: one run of each kind is cut into parts of `PART` windows, counted from the sample, whose key are the
  bytes that all windows of the part hold and whose run are those that they cover; the same three cases apply, and the
  parts that are still undecided fall into single windows;
* samples whose key occurs once: none of their windows repeats.

Groups are only counted and joined back, never gathered; texts are read where they stand, and only those that repeats
touch move. Long texts are read in pieces that overlap, so memory is bounded.

Defined results: null counts as empty; texts shorter than the length keep all bytes; repeated rows are documents of
their own, so all their windows repeat; ids may be null or equal (rows are told apart by id and text); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.bytehash import Rolling, bitmap, maybe_in, mix, text_bytes
from telesift.llm.common import portions, read, released, staged
from telesift.llm.registry import query

LENGTH, SPAN, GRAM = 400, 256, 8  # bytes: repeated string, positions among which its sample is chosen, what is hashed for that
PART = 32  # windows of a part of a run
PIECE = 2_000_000
PLACE = np.uint64((1 << 24) - 1)
RUN = ["first", "windows", "ahead", "key", "run"]


def samples(data: np.ndarray, offsets: np.ndarray, length: int, span: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, sample after first, key, run) of the samples of all windows of the texts in one buffer."""
    none = np.zeros(0, np.int64)
    count = len(data) - length + 1
    if count < 1:
        return none, none, none, none, none, none
    grams = np.ndarray((len(data) - GRAM + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    ranked = np.full(-(-len(data) // span) * span + span, np.uint64(0xFFFFFFFFFFFFFFFF))
    ranked[: len(grams)] = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    blocks = ranked.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) & PLACE).astype(np.int64)

    last = offsets[1:] - length + 1  # after the last window of a text
    cuts = np.r_[0, np.flatnonzero(chosen[1:] != chosen[:-1]) + 1, offsets[:-1], last]
    cuts = np.unique(cuts[(cuts >= 0) & (cuts <= count)])
    first, after = cuts[:-1], cuts[1:]
    text = np.searchsorted(offsets, first, side="right") - 1
    there = first < last[text]
    first, after, text = first[there], after[there], text[there]
    at = chosen[first]
    rolling = Rolling(data)
    key = rolling.ranges(at, at + (length - span))
    run = rolling.ranges(first, after - 1 + length) ^ mix((at - first).astype(np.uint64) + np.uint64(1))
    return text, first - offsets[text], after - first, at - first, key.view(np.int64), run.view(np.int64)


def pieces(column: pa.Array, length: int):
    """(numbers of the texts, starts in the texts, buffer, offsets): all texts at once, or a long one in overlapping pieces."""
    data, offsets = text_bytes(column)
    if len(data) <= PIECE or len(column) > 1:
        yield np.zeros(len(column), np.int64), data, offsets
    else:
        for at in range(0, len(data) - length + 1, PIECE):
            part = data[at : at + PIECE + length - 1]
            yield np.array([at]), part, np.array([0, len(part)])


def sampled(docs: DataFrame, length: int, span: int) -> DataFrame:
    """(doc_id, text_hash, first, windows, ahead, key, run) of all samples."""

    def run(batches):
        for batch in portions(batches, most=PIECE):
            for starts, data, offsets in pieces(batch.column("text"), length):
                text, first, windows, ahead, key, run = samples(data, offsets, length, span)
                at = pa.array(text)
                arrays = [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(first + starts[text]), pa.array(windows, pa.int32()), pa.array(ahead, pa.int32()), pa.array(key), pa.array(run)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", *RUN])

    return docs.mapInArrow(run, run_schema(docs))


def run_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, first long, windows int, ahead int, key long, run long"


def parts_of(first: np.ndarray, windows: np.ndarray, ahead: np.ndarray, key: np.ndarray, rolling: Rolling, length: int, part: int) -> tuple[np.ndarray, ...]:
    """(first, windows, ahead, key, run) of the parts of runs of windows, counted from their samples."""
    low = -ahead // part  # numbers of the first and last part
    count = (windows - 1 - ahead) // part - low + 1
    own = np.repeat(np.arange(len(first)), count)
    number = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    sample = (first + ahead)[own]
    start = np.maximum(first[own], sample + number * part)
    stop = np.minimum((first + windows)[own], sample + (number + 1) * part)
    held = rolling.ranges(sample + (number + 1) * part - 1, sample + number * part + length)
    covered = rolling.ranges(start, stop - 1 + length)
    inner = mix(held + mix(key[own].view(np.uint64) ^ (number + (1 << 32)).astype(np.uint64)))
    return start, stop - start, sample + number * part - start, inner, covered ^ mix((start - sample - number * part).astype(np.uint64) + np.uint64(1))


def induced(rows: DataFrame, length: int, part: int) -> DataFrame:
    """The parts (or, for part = 1, the single windows) of runs; rows have text and runs (first, windows, ahead, key)."""

    def run(batches):
        for batch in portions(batches, most=PIECE):
            for i in range(batch.num_rows):
                data, _ = text_bytes(batch.column("text").slice(i, 1))
                asked = [np.array([r[c] for r in batch.column("runs")[i].as_py()], np.int64) for c in ("first", "windows", "ahead", "key")]
                for at in range(0, len(data), PIECE):
                    here = (asked[0] >= at) & (asked[0] < at + PIECE)
                    if not here.any():
                        continue
                    first, windows, ahead, key = (a[here] for a in asked)
                    rolling = Rolling(data[at : at + PIECE + 2 * length])
                    start, count, ahead, inner, covered = parts_of(first - at, windows, ahead, key, rolling, length, part)
                    n = pa.array(np.zeros(len(start), np.int32))
                    arrays = [batch.column("doc_id").slice(i, 1).take(n), batch.column("text_hash").slice(i, 1).take(n), pa.array(start + at), pa.array(count, pa.int32()), pa.array(ahead, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(inner.view(np.int64)), pa.array(covered.view(np.int64))], names=["doc_id", "text_hash", *RUN])

    return rows.select("doc_id", "text_hash", "text", "runs").mapInArrow(run, run_schema(rows))


def decided(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written runs: those all of whose windows repeat, and one run of each kind that is still undecided, by row."""
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("run").alias("low"), F.max("run").alias("high")).where("n > 1")
    again = staged(found.join(keys.select("key", (F.col("low") < F.col("high")).alias("unlike")), "key"), "repeat-again")
    released(found)
    kinds = again.groupBy("key", "run").agg(F.count("*").alias("n"), F.first("unlike").alias("unlike"), F.min(F.struct("doc_id", "text_hash", "first", "windows", "ahead")).alias("one"))
    kinds = staged(kinds, "repeat-kinds")
    whole = again.join(kinds.where("n > 1").select("key", "run"), ["key", "run"]).select("doc_id", "text_hash", "first", "windows")
    whole = staged(whole, "repeat-whole")
    open_ = kinds.where("unlike").select("one.*", "key").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    open_ = staged(open_.agg(F.collect_list(F.struct("first", "windows", "ahead", "key")).alias("runs")), "repeat-open")
    released(again, kinds)
    return whole, open_


def touched(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose id has its bit; the others do not move."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            there = maybe_in(held.value, batch.column("id_hash").to_numpy())
            if there.any():
                yield batch.filter(pa.array(there))

    return docs.withColumn("id_hash", F.xxhash64("doc_id")).mapInArrow(run, docs.withColumn("id_hash", F.lit(0).cast("long")).schema).drop("id_hash")


def untouched(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The results of the other rows."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in portions(batches, most=PIECE):
            batch = batch.filter(pa.array(~maybe_in(held.value, batch.column("id_hash").to_numpy())))
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield results(batch.column("doc_id"), texts, [None] * len(texts))

    return docs.withColumn("id_hash", F.xxhash64("doc_id")).mapInArrow(run, result_schema(docs))


def result_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def results(ids: pa.Array, texts: list[bytes], spans: list) -> pa.RecordBatch:
    removed, kept, hashes = [], [], []
    for text, own in zip(texts, spans, strict=True):
        merged: list[list[int]] = []
        for start, end in sorted(own or ()):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        left, at = hashlib.sha256(), 0
        for start, end in merged:
            left.update(text[at:start])
            at = end
        left.update(text[at:])
        removed.append([{"start": s, "end": e} for s, e in merged])
        kept.append(sum(e - s for s, e in merged))
        hashes.append(left.hexdigest())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrays = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(hashes, pa.string()), pa.array(removed, kind)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def same_row(left: str = "doc_id", right: str = "_id") -> Column:
    return F.col(left).eqNullSafe(F.col(right)) & (F.col("text_hash") == F.col("_hash"))


def repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed byte ranges of every document."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    whole, undecided = decided(staged(sampled(docs, length, span), "repeat-samples"))
    repeated, done = whole, [whole]
    for part in (PART, 1):
        near = touched(docs, bitmap(undecided, F.col("_id")))
        found = staged(induced(near.join(undecided, same_row()), length, part), "repeat-parts")
        released(undecided)
        whole, undecided = decided(found)
        repeated, done = repeated.union(whole), [*done, whole]
    spans = repeated.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    spans = staged(spans.agg(F.collect_set(F.struct("first", (F.col("first") + F.col("windows") - 1 + length).alias("end"))).alias("spans")), "repeat-spans")
    released(undecided, *done)
    bits = bitmap(spans, F.col("_id"))
    moved = touched(docs, bits).join(spans, same_row(), "left")

    def cut(batches):
        for batch in portions(batches, most=PIECE):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            own = [[(s["first"], s["end"]) for s in x or ()] for x in batch.column("spans").to_pylist()]
            yield results(batch.column("doc_id"), texts, own)

    return untouched(docs, bits).union(moved.select("doc_id", "text", "spans").mapInArrow(cut, result_schema(docs)))


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the byte strings of 400 bytes that start anywhere else as well."""
    return repeats(read(spark, sf_dir, "documents")).drop("spans")
