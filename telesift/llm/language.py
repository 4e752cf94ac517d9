"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces (forward algorithm); a text's score is the sum of its words' log probabilities. The
piece probabilities are fitted by expectation-maximisation on the words of a sample of the labelled texts (`most_docs`
per language, drawn by a hash); expected counts are summed by Spark, and only (language, piece) sums reach the driver.
Whole texts are scored; a word's scores are kept in a bounded cache per worker.

Defined results: a text that is null or has no letter is `und` with score 0; runs of more than 40 letters are cut into
runs of 40; ties go to the language that is first by name; rows without a language teach nothing; if nothing can be
learned, every text is `und`; repeated rows are scored like any others; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import keep_rate, portions, read, remainder, staged
from telesift.llm.registry import query

WORDS = re.compile(r"[^\W\d_]{1,40}")
SPACE = "▁"  # how the vocabulary writes the start of a word
LONGEST = 16  # characters of a piece
FLOOR = 1e-7  # probability of a character that no piece covers
CACHED_WORDS = 400_000
MOST_DOCS, ROUNDS, SMOOTHING = 1200, 3, 0.02


def pieces_of(path: str) -> list[str]:
    """Pieces of a vocabulary file that consist of small letters, with the word-start mark or without."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.vocab_size()))
    return sorted({p for p in found if 0 < len(p) <= LONGEST and p == p.lower() and (p.lstrip(SPACE) == "" or WORDS.fullmatch(p.lstrip(SPACE)))})


class Lattice:
    """All segmentations of many words at once. Words of one length are a matrix of code points."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        rng = np.random.default_rng(7)
        self.base = np.uint64(rng.integers(1 << 40, 1 << 62) | 1)
        self.scramble = rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64)
        keys = np.array([self.hashes(self.codes([p], len(p)))[0, -1] for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.slots = np.full(1 << 20, -1, np.int32)  # by the first bits: where to look in the sorted keys
        top = (self.keys >> np.uint64(44)).astype(np.int64)
        first = np.unique(top, return_index=True)
        self.slots[first[0]] = first[1]
        self.deepest = int(np.bincount(top).max())

    def codes(self, words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Prefix hashes, one column more than characters."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            c = codes[:, i].astype(np.uint64)
            out[:, i + 1] = out[:, i] * self.base + (self.scramble[codes[:, i] & 4095] ^ (c * np.uint64(0x9E3779B97F4A7C15)))
        return out

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece numbers of substrings' hashes, or the number after the last one."""
        at = self.slots[(key >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(key), len(self.pieces), np.int32)
        rows = np.flatnonzero(at >= 0)
        at = at[rows]
        for _ in range(self.deepest):
            hit = self.keys[at] == key[rows]
            out[rows[hit]] = self.ids[at[hit]]
            rows, at = rows[~hit], at[~hit] + 1
            inside = at < len(self.keys)
            rows, at = rows[inside], at[inside]
            if not len(rows):
                break
        return out

    def by_length(self, words: list[str]):
        """(positions, edges) for each length: edges[(start, end)] are the piece numbers of all its words."""
        lengths = np.array([len(w) for w in words])
        powers = np.cumprod(np.r_[np.uint64(1), np.full(LONGEST, self.base, np.uint64)])
        for n in np.unique(lengths):
            for rows in np.array_split(np.flatnonzero(lengths == n), max(1, (lengths == n).sum() * n // 200_000)):
                marked = self.codes([SPACE + words[i] for i in rows], n + 1)
                h = self.hashes(marked)
                edges = {}
                for end in range(1, n + 2):
                    for start in range(max(0, end - LONGEST), end):
                        found = self.find(h[:, end] - h[:, start] * powers[end - start])
                        if end - start == 1 or (found < len(self.pieces)).any():
                            edges[start, end] = found
                yield rows, n + 1, edges

    def forward(self, prob: np.ndarray, n: int, edges: dict) -> list[np.ndarray]:
        """prob: (pieces + 1, languages), its last row 0. Sums over the segmentations of every prefix."""
        alpha = [np.ones((len(next(iter(edges.values()))), prob.shape[1]))]
        for end in range(1, n + 1):
            total = alpha[end - 1] * FLOOR
            for start in range(max(0, end - LONGEST), end):
                if (start, end) in edges:
                    total = total + alpha[start] * prob[edges[start, end]]
            alpha.append(total)
        return alpha

    def log_likelihood(self, prob: np.ndarray, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), prob.shape[1]))
        for rows, n, edges in self.by_length(words):
            out[rows] = np.log(self.forward(prob, n, edges)[n])
        return out

    def expected(self, prob: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts; counts: (words, languages)."""
        out = np.zeros_like(prob)
        for rows, n, edges in self.by_length(words):
            alpha = self.forward(prob, n, edges)
            beta = [None] * n + [np.ones_like(alpha[0])]
            for start in range(n - 1, -1, -1):
                total = beta[start + 1] * FLOOR
                for end in range(start + 1, min(n, start + LONGEST) + 1):
                    if (start, end) in edges:
                        total = total + beta[end] * prob[edges[start, end]]
                beta[start] = total
            weight = counts[rows] / alpha[n]
            for (start, end), found in edges.items():
                there = found < len(self.pieces)
                np.add.at(out, found[there], (alpha[start] * beta[end] * weight)[there] * prob[found[there]])
        return out


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def fit(labelled: DataFrame, vocabulary: str, most_docs: int = MOST_DOCS, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities): labelled has doc_id, text and lang; at most about `most_docs` texts per language are read."""
    spark = labelled.sparkSession
    labelled = labelled.where("lang is not null")
    totals = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, pieces = sorted(totals), pieces_of(vocabulary)
    prob = np.full((len(pieces) + 1, len(langs)), 1.0 / len(pieces))
    prob[-1] = 0.0
    if not langs:
        return langs, pieces, prob
    rates = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, keep_rate(n, most_docs))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.where(draw < rates[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in portions(batches):
            met = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                met.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in met], pa.string()), pa.array([k[1] for k in met], pa.string()), pa.array(list(met.values()), pa.int64())], names=["lang", "word", "n"]
            )

    counted = staged(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    place = {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(prob)

        def expect(batches, held=held):
            lattice, out = Lattice(pieces), 0
            for batch in batches:
                words, n = batch.column("word").to_pylist(), np.zeros((batch.num_rows, len(langs)))
                n[np.arange(len(words)), [place[x] for x in batch.column("lang").to_pylist()]] = batch.column("n").to_numpy()
                out = out + lattice.expected(held.value, words, n)
            if isinstance(out, np.ndarray):
                piece, lang = np.nonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(out[piece, lang])], names=["piece", "lang", "n"])

        sums = counted.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.zeros_like(prob)
        new[sums.piece, sums.lang] = sums.n
        new[:-1] += SMOOTHING
        prob = new / new.sum(axis=0)
        prob[-1] = 0.0
    return langs, pieces, prob


_scored: dict[str, dict] = {}  # per worker process: the lattice and words' scores by model


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """Adds lang_pred and score (posterior probability, languages equally likely before) to (doc_id, text, further columns)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    key = f"{id(model)}-{np.random.default_rng().integers(1 << 62)}"

    def run(batches):
        langs, pieces, prob = held.value
        if key not in _scored:
            _scored.clear()
            _scored[key] = {"lattice": Lattice(pieces), "at": {}, "scores": np.zeros((0, len(langs)))}
        memo = _scored[key]
        for batch in portions(batches, most=2_000_000):
            parts = [words_of(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(p) for p in parts])
            total = np.zeros((len(parts), len(langs)))
            if langs and sizes.sum():
                if len(memo["at"]) > CACHED_WORDS:
                    memo |= {"at": {}, "scores": memo["scores"][:0]}
                if new := list(set().union(*parts).difference(memo["at"])):
                    memo["at"].update(zip(new, range(len(memo["at"]), len(memo["at"]) + len(new)), strict=True))
                    memo["scores"] = np.concatenate([memo["scores"], memo["lattice"].log_likelihood(prob, new)])
                at = np.fromiter((memo["at"][w] for p in parts for w in p), np.int64, sizes.sum())
                np.add.at(total, np.repeat(np.arange(len(parts)), sizes), memo["scores"][at])
            known = (sizes > 0) & bool(langs)
            best = total.argmax(axis=1) if langs else np.zeros(len(parts), int)
            score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if langs else np.zeros(len(parts))
            cols = [batch.column(f.name) for f in kept]
            cols += [pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + ["lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of them by a hash of the id teach nothing."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
