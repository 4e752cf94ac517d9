"""Licence scan: TF-IDF cosine of sentences to licence templates, then inheritance from the nearest ancestor directory.

Every file is cut into sentences (at line ends and after `. `, `! `, `? `), which are compared with the sentences of the
templates. The document frequencies of the templates' terms count all files; a term that no template has weighs like one
of a single file. Only sentences with a strong term are scored: the terms that remain of a template without its strong
ones cannot reach the threshold (Cauchy-Schwarz), so nothing is lost. A file is a licence file if sentences that match
hold at least half of its words, or if its name says so; it speaks for its directory. A file without a licence of its
own takes that of the nearest directory above it that has one, by joins on paths.

Defined results: null and empty texts, and texts that no sentence of matches, have no licence of their own; ties of
cosine go to the template that is first in the list, those of licence files in one directory to the smaller path; a
null path has no directory and inherits nothing; repeated rows are files of their own; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telesift.llm.common import portions, read, staged
from telesift.llm.registry import query

THRESHOLD = 0.6
TERM = re.compile(r"[a-z0-9]+")
SENTENCE = re.compile(r"\n|(?<=[.!?])\s")
FILE_NAME = re.compile(r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][a-z0-9]+)?$")
#: Public names and notices of licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the 3-clause BSD License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text))


class Matcher:
    """Cosines of sentences to the templates."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], files: int, threshold: float):
        self.names = [n for n, _ in templates]
        self.threshold, self.rare = threshold, np.log((1.0 + files) / 2.0) + 1.0
        self.idf = {t: np.log((1.0 + files) / (1.0 + n)) + 1.0 for t, n in df.items()}
        vectors = [{t: n * self.weight(t) for t, n in terms(x.lower()).items()} for _, x in templates]
        self.unit, self.strong = [], set()
        for v in vectors:
            norm = np.sqrt(sum(w * w for w in v.values()))
            self.unit.append({t: w / norm for t, w in v.items()})
            left = threshold * threshold * norm * norm
            for t in sorted(v, key=lambda t: (v[t], t)):  # the weakest terms that stay below the threshold together
                left -= v[t] * v[t]
                if left <= 0:
                    self.strong.add(t)

    def weight(self, term: str) -> float:
        return self.idf.get(term, self.rare)

    def best(self, sentence: str) -> tuple[int, float]:
        found = terms(sentence)
        v = {t: n * self.weight(t) for t, n in found.items()}
        norm = np.sqrt(sum(w * w for w in v.values()))
        scores = [sum(w * v[t] for t, w in u.items() if t in v) / norm for u in self.unit]
        i = int(np.argmax(scores))
        return i, float(min(1.0, scores[i]))


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Files that hold each term of the vocabulary, and all files."""

    def run(batches):
        wanted, met, n = frozenset(vocabulary), Counter(), 0
        for batch in portions(batches):
            for text in batch.column("text").to_pylist():
                n += 1
                if text:
                    met.update(wanted.intersection(TERM.findall(text.lower())))
        yield pa.RecordBatch.from_arrays([pa.array([*met, ""]), pa.array([*met.values(), n], pa.int64())], names=["term", "n"])

    found = {r.term: r.n for r in files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {t: found.get(t, 0) for t in vocabulary}, found.get("", 0)


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds licence, score, licences (all found), and licence_file to (path, text, further columns)."""
    vocabulary = sorted(set().union(*(terms(x.lower()) for _, x in templates)))
    df, n = frequencies(files, vocabulary)
    added = ("text", "licence", "score", "licences", "licence_file", "origin", "from_path")
    kept = [f for f in files.schema.fields if f.name not in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["licence string, score double, licences array<string>, licence_file boolean"])

    def scan(text: str | None, path: str | None, matcher: Matcher, machine) -> tuple:
        low = (text or "").lower()
        best, found, words, done = None, set(), 0, -1
        if len(matcher.strong):
            for at, _ in machine.iter(low):
                if at < done:
                    continue
                # the sentence around the hit
                cuts = [m.end() for m in SENTENCE.finditer(low, max(0, low.rfind("\n", 0, at)), at)]
                start = cuts[-1] if cuts else max(0, low.rfind("\n", 0, at) + 1)
                stop = SENTENCE.search(low, at)
                done = stop.start() if stop else len(low)
                sentence = low[start:done]
                if matcher.strong.isdisjoint(TERM.findall(sentence)):
                    continue
                i, score = matcher.best(sentence)
                if score >= matcher.threshold:
                    found.add(matcher.names[i])
                    words += len(sentence.split())
                    if best is None or (-score, i) < best:
                        best = (-score, i)
        whole = len(low.split())
        named = bool(path and FILE_NAME.search(path))
        return (matcher.names[best[1]], -best[0], sorted(found), named or 2 * words >= whole) if best else (None, None, [], False)

    def run(batches):
        import ahocorasick

        matcher = Matcher(templates, df, n, threshold)
        machine = ahocorasick.Automaton()
        for t in matcher.strong:
            machine.add_word(t, t)
        machine.make_automaton()
        for batch in portions(batches):
            rows = [scan(t, p, matcher, machine) for t, p in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.name for f in kept] + ["licence", "score", "licences", "licence_file"])

    return files.mapInArrow(run, schema)


def inherited(scanned: DataFrame) -> DataFrame:
    """Fills licence from the nearest directory with a licence file; adds origin (own, inherited, none) and from_path."""
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    scanned = staged(scanned.withColumn("_dir", directory), "licences-own")
    speaks = scanned.where("licence_file").groupBy(F.col("_dir").alias("_above")).agg(F.min(F.struct("path", "licence")).alias("_by"))
    asks = scanned.where("licence is null and path is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = asks.select("_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("_depth"))
    above = above.withColumn("_above", F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), F.col("_depth")), "/"))
    nearest = above.join(speaks, "_above").withColumn("_rank", F.row_number().over(W.partitionBy("_dir").orderBy(F.desc("_depth")))).where("_rank = 1")
    nearest = nearest.select("_dir", "_by")
    out = scanned.join(nearest, "_dir", "left")
    taken = F.when(F.col("licence").isNull() & F.col("path").isNotNull(), F.col("_by"))
    return out.withColumn("origin", F.when(F.col("licence").isNotNull(), "own").when(taken.isNotNull(), "inherited").otherwise("none")).withColumn(
        "from_path", F.coalesce(F.when(F.col("licence").isNotNull(), F.col("path")), taken["path"])
    ).withColumn("licence", F.coalesce("licence", taken["licence"])).drop("_dir", "_by")


def licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    return inherited(own_licences(files, templates, threshold))


@query("op6_licences")
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, whose path is its source, its language and its id."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string"))
    return licences(docs.select("doc_id", path.alias("path"), "text"))
