"""Packing by vector bin packing: examples with three sizes (tokens, segments, loss-bearing tokens) into sequences.

A sequence has a limit on each of the three. The dot-product heuristic fills one sequence at a time: of the examples
that fit, it takes the one whose sizes, as shares of the limits, have the largest dot product with what is left. What
nothing fits into any more is filled with a part of the next example (where cutting is allowed). Every task packs its
own rows, batch by batch, with a bounded pool; the last open sequence of a task is cut into power-of-two lengths, which
need no padding. Sequence numbers are unique over tasks: the partition's number, then a count.

Defined results: a null text is empty and consists of the end token alone; ties go to the example that came first;
repeated rows are packed like any others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import give_back, portions, read, tidied
from telesift.llm.registry import query

END = 2
MOST_TOKENS, MOST_SEGMENTS, MOST_LOSS = 4096, 1024, 4096
CACHED_WORDS = 700_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Words:
    """Token ids of texts, word by word (blanks and line ends always part tokens), with a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.cache: dict[str, bytes] = {}  # ids of words met before
        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encoded(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Letters before a run of ASCII punctuation are one pre-token, the run is another; so each distinct run of letters
        is encoded once, all of them in one call, and they are parted at word-end tokens."""
        cores = [w.rstrip(string.punctuation) for w in words]
        letters = sorted({c for c in cores if c.isalpha()})
        ids = np.array(self.model.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(letters):  # some letter is written with more than letters in lower case
            self.cache.update(zip(words, self.encoded(words), strict=True))
            return
        blob = ids.tobytes()
        known = dict(zip(letters, (blob[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True)) if letters else {}
        rest = list({w[len(c) :] if c in known else w for w, c in zip(words, cores, strict=True)} - {""})
        other = dict(zip(rest, self.encoded(rest), strict=True)) | {"": b""}
        self.cache.update((w, known[c] + other[w[len(c) :]] if c in known else other[w]) for w, c in zip(words, cores, strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text as little-endian 32-bit numbers; each distinct word of the batch is looked up once."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        plain = pc.invert(pc.match_substring(texts, "<|"))  # which could become a special token
        low = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,]) ", "\\1 \\2 ")  # neither changes a token
        parts = pc.split_pattern(pc.if_else(plain, low, texts), " ")
        coded = parts.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        if new := [w for w in words if w not in self.cache]:
            self.learn(new)
        blobs = [self.cache[w] for w in words]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        taken = sizes[at]
        ends = np.cumsum(taken)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.r_[0, ends][np.asarray(parts.offsets) - parts.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]


class Packer:
    """Fills sequences from a pool of (doc_id, blob of ids, start, length, loss tokens, all tokens)."""

    def __init__(self, partition: int, limits: tuple[int, int, int], cut: bool):
        self.limits, self.cut = np.array(limits, float), cut
        self.sequence = partition << 33
        self.open: list[tuple] = []  # pieces of the open sequence
        self.used = np.zeros(3)

    def close(self) -> Iterator[tuple]:
        offset = 0
        for doc, blob, start, length, loss, total in self.open:
            yield doc, start, length, zlib.crc32(blob[4 * start : 4 * (start + length)]), total, loss, self.sequence, offset
            offset += length
        self.open, self.used = [], np.zeros(3)
        self.sequence += 1

    def parted(self, item: tuple, length: int) -> tuple[tuple, tuple]:
        doc, blob, start, whole, loss, total = item
        first = round(loss * length / whole)
        return (doc, blob, start, length, first, total), (doc, blob, start + length, whole - length, loss - first, total)

    def put(self, item: tuple) -> None:
        self.open.append(item)
        self.used += (item[3], 1, item[4])

    def pack(self, items: list[tuple]) -> Iterator[tuple]:
        """Places all items; the last sequence stays open for the next call."""
        sizes = np.array([(x[3], 1, x[4]) for x in items], float).reshape(-1, 3)
        there = np.ones(len(items), bool)
        share = sizes / self.limits
        for _ in range(len(items)):
            while True:
                left = self.limits - self.used
                fits = there & (sizes <= left).all(axis=1)
                if fits.any():
                    score = np.where(fits, share @ (left / self.limits), -1.0)
                    i = int(score.argmax())
                    there[i] = False
                    self.put(items[i])
                    break
                i = int(there.argmax())
                room = int(min(left[0], left[2] * items[i][3] // max(items[i][4], 1)))
                if self.cut and left[1] >= 1 and 0 < room < items[i][3]:
                    head, rest = self.parted(items[i], room)
                    self.put(head)
                    items[i], sizes[i] = rest, (rest[3], 1, rest[4])
                    share[i] = sizes[i] / self.limits
                elif not self.open:
                    raise ValueError("an example exceeds the limits and cutting is off")
                yield from self.close()

    def full(self, item: tuple) -> Iterator[tuple]:
        """Whole sequences off a long example, without touching the open one; what is left comes last, unplaced."""
        most = int(min(self.limits[0], self.limits[2] * item[3] // max(item[4], 1)))
        held = self.open, self.used
        while self.cut and item[3] > most:
            self.open, self.used = [], np.zeros(3)
            head, item = self.parted(item, most)
            self.put(head)
            yield from self.close()
        self.open, self.used = held
        yield item

    def finish(self) -> Iterator[tuple]:
        """The open sequence, cut into power-of-two lengths, largest first."""
        rest, self.open, self.used = self.open, [], np.zeros(3)
        if not self.cut:
            self.open = rest
        while self.cut and rest:
            want = 1 << (sum(x[3] for x in rest).bit_length() - 1)
            while want:
                item = rest.pop(0)
                if item[3] > want:
                    item, more = self.parted(item, want)
                    rest.insert(0, more)
                self.put(item)
                want -= item[3]
            yield from self.close()
        if self.open:
            yield from self.close()


def pack(
    docs: DataFrame, vocabulary: str, limits: tuple[int, int, int] = (MOST_TOKENS, MOST_SEGMENTS, MOST_LOSS), cut: bool = True, loss: Column | None = None
) -> DataFrame:
    """Pieces of all documents with their place: see PIECE. `loss` is the share of a document's tokens that bear loss (default: all).

    `vocabulary` is the path of a tokenizer file that every machine has.
    """

    def run(batches):
        words, packer = Words(vocabulary), Packer(TaskContext.get().partitionId(), limits, cut)
        for batch in portions(batches):
            rows, items = [], []
            for doc, blob, bearing in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text")), batch.column("bearing").to_pylist(), strict=True):
                blob += END.to_bytes(4, "little")
                total = len(blob) // 4
                *done, rest = packer.full((doc, blob, 0, total, round(total * bearing), total))
                rows += done
                items.append(rest)
            rows.extend(packer.pack(items))
            yield table(rows)
            give_back()
        yield table(list(packer.finish()))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECE.split(", ")]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    bearing = F.lit(1.0) if loss is None else F.coalesce(loss.cast("double"), F.lit(1.0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", bearing.alias("bearing")).mapInArrow(tidied(run), PIECE)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of at most 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
