"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame operations only. A source's target is its share of the budget, at most `max_epochs` times its own size; the
excess of the sources at that bound goes to the others in proportion to their weights until no target is above its
bound. Within a source every document is taken floor(target / size) times as a whole; the rest of the target is taken
from the documents in the order of a seeded digest, the last one in part, so that the words taken equal the target to
the word.

Defined results: a null text or a text without words has size 0 and takes 0; the null source is a source of its own
and the last by rank; an empty table gives no rows; repeated rows are laid out one after the other like any others;
further columns of the input are ignored (`mix`) or kept as they are (`mixed`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telesift.functions.hashing import digest, uniform
from telesift.llm.common import WORD, ordinals, packed, read, settled, staged
from telesift.llm.registry import query

SEED = "mix-1"
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds `target` to a table of (source_size, weight): the level rises until the capped sources stay the same.

    Only three sums per step reach the driver, whatever the number of sources.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, capped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        r = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if r.n == capped or r.open == 0.0:
            break
        level, capped = (budget - r.held) / r.open, r.n
    return sources.withColumn("target", F.when(full, cap).otherwise(F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) for every document.

    The order within a source is cut into about sqrt(n) digest ranges: ranges are summed first, and the running sum is
    taken inside a range plus the sum of the ranges before it, so a source with a third of all rows is many equal tasks.
    """
    sizes = staged(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"), digest(seed, F.col("doc_id")).alias("draw"), uniform(seed, F.col("doc_id")).alias("u")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = ordinals(sources, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    filled = staged(water_fill(ranked.withColumn("weight", weight), budget * total, max_epochs), "mix-targets")

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    filled = filled.select(
        F.col("source").alias("_source"), "source_size", "target", epochs.alias("epochs"),
        F.floor(F.col("target") - epochs * F.col("source_size")).alias("extra"), F.ceil(F.sqrt(F.col("n"))).alias("ranges"),
    )
    placed = sizes.join(filled, F.col("source").eqNullSafe(F.col("_source"))).withColumn("range", F.floor(F.col("u") * F.col("ranges")))
    sums = placed.groupBy("_source", "range").agg(F.sum("size").alias("range_size"))
    before = sums.withColumn("before", F.coalesce(F.sum("range_size").over(W.partitionBy("_source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("_source").alias("_s"), F.col("range").alias("_r"), "before")
    inside = W.partitionBy("source", "range").orderBy("draw", "size", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("ahead") - F.col("before")))
    return laid.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of the documents: whole copies, and the first words of one document per source.

    A document of size 0 has no words to take and appears in no mix.
    """
    key = [F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "size"]
    chosen = settled(lambda: mix(docs, **options).groupBy(*key).agg(F.sum("taken").alias("taken"), F.count("*").alias("rows")), "mix-chosen")
    # rows that are repeated with their id share what the mix takes of them
    chosen = chosen.where("taken > 0").withColumn("taken", F.ceil(F.col("taken") / F.col("rows")))
    rows = packed(docs, key=F.col("doc_id"), key_hash=F.xxhash64("text")).join(chosen, F.col("key").eqNullSafe(F.col("id")) & (F.col("key_hash") == F.col("hash")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    whole = left >= F.col("size")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    rows = rows.withColumn("cut", F.when(~whole, F.array_join(F.slice(words, F.lit(1), left.cast("int")), "")))
    new = {"text": F.coalesce("cut", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix-1|' || doc_id::varchar) as draw
  from documents),
s as (select source, sum(size)::double as s, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select *, case k % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w from s),
t as (select 1.5::double * sum(s) as budget from w),
f as (select a.source, a.s, a.w, sum(least(2 * b.s, 2 * a.s / a.w * b.w)) <= (select budget from t) as capped
      from w a, w b group by a.source, a.s, a.w),
l as (select ((select budget from t) - coalesce(sum(case when capped then 2 * s end), 0)) / sum(case when not capped then w end) as level from f),
g as (select source, s, case when capped then 2 * s else (select level from l) * w end as target from f),
x as (select d.*, g.s, g.target, case when g.s > 0 then floor(g.target / g.s) else 0 end as epochs,
        coalesce(sum(size) over (partition by d.source order by draw, size, doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
      from d join g on d.source is not distinct from g.source)
select doc_id, size, s::bigint as source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * s) - ahead)))::bigint as taken
from x
"""


@query("op3_mixing", SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its share of a mix of 150 % of all words, sources weighing 3, 1, 2 in turn and at most twice."""
    return mix(read(spark, sf_dir, "documents")).drop("source", "text_hash")
