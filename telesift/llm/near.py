"""N-gram Jaccard join by parity sketches, and the groups of near duplicates it links.

A text is the set of its hashed word shingles. All sets of a size band are cut by hash into the same cells, and a cell's
parity sketch is the XOR of its members' hashes: two sets differ in at most as many cells as their symmetric difference
has members. A Jaccard similarity of t bounds that difference by (1 - t) / (1 + t) of the sum of the sizes; a set that
shows one filled cell more than this bound must share a cell with every similar set, so the join of equal (band, cell,
sketch) loses no pair. Sizes of similar sets differ by 1 / t at most, so a set shows its cells in its own band and in
the next. Shingles that a sample finds in many texts are kept out of the cells (they count as one cell that is never
shown), which keeps common passages from making large groups; a set with too few other cells also shows cells over all
its shingles. Every set also has one parity sketch of 1024 bits; pairs whose sketches differ in more bits than the sets may
differ are dropped inside the joins, and all others are verified on the shingles themselves.

Groups of equal cells are not expanded into all pairs: their members are paired with the first member, then with the
next one of another component in two orders, the links found are joined to components each time, and only members of
groups that still span several components are paired across components.
Sets that are equal are one class from the start; sketches move once per class and task.

Defined results: texts that are null or have no word have an empty set, no link and their own id as component; with
fewer words than a shingle has, the whole sequence is the only shingle; repeated rows are copies of each other; rows
whose id is null take part, but a component's id is the smallest that is not null; an empty table gives no rows;
repeated rows of the kept one stay with it; further columns are ignored (`components`) or kept (`kept_documents`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telesift.llm.bytehash import BLANK, CASELESS, Rolling, bitmap, maybe_in, mix, text_bytes
from telesift.llm.common import keep_rate, portions, read, released, settled, staged, tidied, without
from telesift.llm.registry import query

SHINGLE, SIMILARITY = 5, 80  # words; hundredths
SAMPLED, COMMON = 4000, 0.004  # texts that are looked at for common shingles; share of them from which one is common
PIECE = 4_000_000
BITS = 1024
LONGS = [f"bits{i}" for i in range(BITS // 64)]
TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def salt(number: int, turn: int) -> np.uint64:
    return np.uint64(number * int(TURNS[turn]) & 0xFFFFFFFFFFFFFFFF)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, A-Z as a-z; n + 1 offsets of the texts' words). Long buffers go piece by piece, cut at blanks."""
    if len(data) > PIECE and len(offsets) == 2:
        blanks, parts, at = np.flatnonzero(BLANK[data]), [], 0
        while at < len(data):
            k = np.searchsorted(blanks, at + PIECE)
            end = int(blanks[k]) + 1 if k < len(blanks) else len(data)
            parts.append(word_hashes(data[at:end], np.array([0, 0, end - at]))[0])
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    solid = np.ones(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's first byte
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return Rolling(data, CASELESS).ranges(starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, at = word_hashes(*text_bytes(column))
    runs = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        runs += words[j : j + len(runs)] * TURNS[j]
    runs = mix(runs)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(runs[lo : hi - n + 1])
        elif hi > lo:
            yield mix(np.array([(words[lo:hi] * TURNS[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def class_id(hashes: np.ndarray) -> int:
    """Identifier of a set: a 63-bit hash of its sum and XOR under two mixings."""
    if not len(hashes):
        return 0
    s = mix(mix(hashes + TURNS[5]).sum(keepdims=True) ^ TURNS[6]) + np.bitwise_xor.reduce(mix(hashes ^ TURNS[7]))
    return int(mix(s + np.uint64(len(hashes)))[0] >> np.uint64(1))


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the members by bit position; two sketches differ in as many bits at most as the sets do in members."""
    odd = np.bincount((mix(hashes ^ TURNS[6]) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_of(n: int, similarity: int) -> int:
    """Bands are [edge(k), edge(k + 1)) with edges that grow by 1 / similarity."""
    k = max(0, int(np.log(n) / np.log(100 / similarity)))
    while edge(k + 1, similarity) <= n:
        k += 1
    while edge(k, similarity) > n:
        k -= 1
    return k


def edge(k: int, similarity: int) -> int:
    return int(np.ceil((100 / similarity) ** k - 1e-9))


def sketches(hashes: np.ndarray, common: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """The cells that a set shows, each as one number made of band, cell, members' parity and count."""
    n, out = len(hashes), []
    rare = hashes[~np.isin(hashes, common)] if len(common) else hashes
    k = band_of(n, similarity)
    for band in (k, k + 1):
        most = edge(band + 1, similarity) - 1  # largest size in the band
        differ = (100 - similarity) * (n + min(n * 100 // similarity, most)) // (100 + similarity)
        cells = np.uint64((100 - similarity) * 2 * most // (100 + similarity) * 108 // 100 + 4)
        for family, members in enumerate((rare, hashes)):
            # sorted by hash, hence by cell: the product's high word
            cell = ((members >> np.uint64(32)) * cells) >> np.uint64(32)
            begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
            if len(begin):
                parity = np.bitwise_xor.reduceat(mix(members ^ TURNS[4]), begin)
                size = np.diff(np.r_[begin, len(cell)]).astype(np.uint64)
                shown = mix(parity + mix(cell[begin] + (size << np.uint64(40))) + salt(band * 2 + family + 1, 3))
            else:
                shown = np.zeros(0, np.uint64)
            enough = len(shown) > differ
            out.append(shown[: differ + 1])
            if enough:
                break
        if not enough:  # so few filled cells that only empty ones may be shared: these are shown as well
            empty = np.setdiff1d(np.arange(cells, dtype=np.uint64), cell[begin])
            out.append(mix(empty + salt(band * 2 + 1, 2)))
    return np.concatenate(out)


def sets_info(docs: DataFrame, n: int, rate: float) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, sampled, bits): sampled has the shingles of a hash draw of the classes."""

    def run(batches):
        for batch in portions(batches):
            sizes, ids, some, bits = [], [], [], []
            for s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                ids.append(class_id(s))
                bits.append(bit_sketch(s))
                some.append(s.view(np.int64) if ids[-1] % 1_000_003 < rate * 1_000_003 else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(some, pa.list_(pa.int64())), *map(pa.array, np.array(bits, np.int64).reshape(-1, len(LONGS)).T.copy())], names=["doc_id", "text_hash", "n_shingles", "class", "sampled", *LONGS])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(tidied(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, class long, sampled array<long>, " + ", ".join(f"{b} long" for b in LONGS))


def shown_cells(docs: DataFrame, common: np.ndarray, n: int, similarity: int) -> DataFrame:
    """(sketch, class) rows; a class shows its cells once in a task."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen: set[int] = set()
        for batch in portions(batches):
            cells, classes = [], []
            for s in shingle_sets(batch.column("text"), n):
                c = class_id(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    cells.append(sketches(s, held.value, similarity))
                    classes.append(np.full(len(cells[-1]), c, np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(classes))], names=["sketch", "class"])

    return docs.select("text").mapInArrow(tidied(run), "sketch long, class long")


def bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text) of the wanted rows (doc_id, text_hash, class), copies included; texts of others mostly stay where they are."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.xxhash64("doc_id", "text_hash")))

    def run(batches):
        for batch in batches:
            there = maybe_in(bits.value, batch.column("h").to_numpy())
            if there.any():
                yield batch.filter(pa.array(there)).select(["doc_id", "text_hash", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").select("*", F.xxhash64(F.xxhash64("doc_id", "text_hash")).alias("h"))
    near = rows.mapInArrow(tidied(run), f"doc_id {kind}, text_hash long, text string")
    w = wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "class")
    return near.join(w, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("class", "text")


def verified(pairs: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """Of pairs (a, b) those whose shingle sets are similar."""
    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            for small in portions(portions([batch], "text_a", PIECE), "text_b", PIECE):
                linked, last, one = [], None, None
                for a, b, ca, cb in zip(shingle_sets(small.column("text_a"), n), shingle_sets(small.column("text_b"), n), small.column("a").to_pylist(), small.column("b").to_pylist(), strict=True):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    same = class_id(a) == ca and class_id(b) == cb  # an id that two different texts have
                    linked.append(same and 100 * common >= similarity * (len(a) + len(b) - common))
                yield small.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(class, label) for every end of the edges (a, b): label is the smallest class of its component.

    Smallest labels of neighbours, then labels of labels, until nothing changes; every step is written.
    """
    both = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("u").alias("class")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("class").alias("v"), F.col("label").alias("other")), "v").groupBy(F.col("u").alias("class")).agg(F.min("other").alias("other"))
        low = labels.join(seen, "class", "left").select("class", "label", F.least("label", "other").alias("low"))
        up = labels.select(F.col("class").alias("low"), F.col("label").alias("jump"))
        new = staged(low.join(up, "low", "left").select("class", F.least("low", "jump").alias("next"), "label"), "labels")
        moved = new.where("next < label").limit(1).count()
        old, labels = labels, new.select("class", F.col("next").alias("label"))
        labels.staged_at = new.staged_at
        released(old)
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def links(docs: DataFrame, info: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between classes, enough to connect every pair of similar classes."""
    classes = info.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.max("n_shingles").alias("size"), *[F.max(b).alias(b) for b in LONGS])
    classes = staged(classes, "near-classes")
    found = info.where("sampled is not null").select("class", "sampled").dropDuplicates(["class"])
    drawn = found.count()
    counted = found.select(F.explode("sampled").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= max(8, COMMON * drawn))
    # at most (mean size) / COMMON shingles can be this common in the sample
    common = np.sort(np.array([r.s for r in counted.select("s").collect()], np.int64).view(np.uint64))

    shown = shown_cells(docs, common, n, similarity)
    group = W.partitionBy("sketch")
    live = shown.withColumn("first", F.min("class").over(group)).withColumn("last", F.max("class").over(group)).where("first < last")
    live = staged(live.select("sketch", "class", "first").distinct(), "near-cells")

    def side(x: str) -> DataFrame:
        return classes.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}"), *[F.col(b).alias(f"{b}_{x}") for b in LONGS])

    # the sizes allow the similarity, and so do the bits in which the sketches differ
    total = F.col("size_a") + F.col("size_b")
    alike = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * similarity
    alike = alike & (reduce(add, [F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in LONGS]) * (100 + similarity) <= total * (100 - similarity))

    def check(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(classes, "class").select("row.doc_id", "row.text_hash", "class")
        needed = staged(needed, "near-needed")
        texts = staged(bodies(docs, needed).dropDuplicates(["class"]), "near-texts")
        out = staged(verified(pairs, texts, n, similarity), "near-links")
        released(texts, needed)
        return out

    def spanning(label: DataFrame) -> DataFrame:
        """The members of the groups of equal cells that span several components."""
        named = live.select("sketch", "class").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
        many = named.groupBy("sketch").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sketch")
        return staged(named.join(many, "sketch"), "near-mixed")

    def chained(mixed: DataFrame) -> DataFrame:
        """Each member with the next one of another component, in two orders."""
        out = None
        for order in ("class", F.xxhash64("class", "sketch")):
            w = W.partitionBy("sketch").orderBy(order)
            next_ = mixed.select(F.col("class").alias("c"), F.lead("class").over(w).alias("d"), "label", F.lead("label").over(w).alias("other")).where("label <> other")
            pairs = next_.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
            out = pairs if out is None else out.union(pairs)
        return out.distinct()

    stars = live.where("class > first").select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    tested = staged(stars.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"), "near-pairs")
    linked = check(tested)
    mixed = spanning(connected(linked))
    more = chained(mixed).join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b")
    more = staged(more.join(tested, ["a", "b"], "left_anti"), "near-pairs")
    linked = staged(linked.union(check(more)), "near-links")
    released(mixed)
    mixed = spanning(connected(linked))
    left = mixed.select("sketch", F.col("class").alias("a"), F.col("label").alias("la")).join(side("a"), "a")
    right = mixed.select("sketch", F.col("class").alias("b"), F.col("label").alias("lb")).join(side("b"), "b")
    across = left.join(right, (left["sketch"] == right["sketch"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & alike).select("a", "b")
    rest = staged(across.distinct().join(tested.union(more), ["a", "b"], "left_anti"), "near-pairs")
    return linked.union(check(rest))


def components(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of every row: one row of each component is kept, and all rows without words."""
    rate = keep_rate(docs.count(), SAMPLED)
    info = staged(sets_info(docs, n, rate), "near-info")
    label = connected(links(docs, info, n, similarity))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    named = info.where("n_shingles > 0").groupBy("class").agg(F.min(place).alias("least"))
    named = named.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("least").alias("first"))
    of = staged(named.join(least, "label").select("class", "first"), "near-components")
    filled = info.join(of, "class", "left").withColumn("first", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(place))
    return filled.select("doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("first") == place).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that of the smallest id. Texts without words all stay."""
    gone = settled(lambda: components(docs).where(~F.col("kept")).select("doc_id", "text_hash").distinct(), "near-gone")
    return without(docs, gone, F.col("doc_id"), F.xxhash64("text"))


@query("op8_near_join")
def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, Jaccard similarity 0.8 or more."""
    return components(read(spark, sf_dir, "documents")).drop("text_hash", "kept")
