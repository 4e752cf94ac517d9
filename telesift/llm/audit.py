"""Audit of how five filters interact, over every order in which they can run.

Four filters look at a text alone; the fifth (E) fails a document whose text is that of a smaller doc_id. E is an
existential self-join: the documents are left-semi joined with the first ids of the texts on hash, exact text and
smaller id. The rows it finds are united with those that fail the other filters, one bit each; per part only the
counts of the 32 bit combinations are left, and all 120 orders are read off them.

Hot groups: digests are counted first, and only texts whose digest is repeated under two ids travel. The first ids are
pre-aggregated before their exchange. A digest with more than 1 / SHARES of the rows is dealt over blocks on the left
side, and its first id is repeated once per block, so copies that make up a third of the table are many equal tasks.

Defined results: a null text counts as empty; a null lang is the part ''; a null doc_id is never smaller than another
and has none smaller, so it does not fail E; repeated rows count one by one and are no copies of each other (their ids
are equal); an id with several texts is several documents; with several labels of one id the document is good (toxic)
if one of them says so, and a null label says nothing; an empty table has no parts and gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import BITS, WORD, bit_table, perhaps_in, read, staged
from telesift.llm.registry import query

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
#: A digest with more than 1 / SHARES of all rows is dealt over blocks of about that many rows.
SHARES = 1024


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D for a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return F.when(F.size(words) < 200, BIT["A"]).otherwise(0).bitwiseOR(
        F.when(100 * F.size(F.array_distinct(words)) < 50 * F.size(words), BIT["B"]).otherwise(0)).bitwiseOR(
        F.when(100 * capitals.cast("long") > 3 * F.length(text).cast("long"), BIT["C"]).otherwise(0)).bitwiseOR(
        F.when(text.rlike(r"[#$%&*|]"), BIT["D"]).otherwise(0))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text, digest) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def copies(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(doc_id, part, digest) of the rows that have the text of a smaller id; `digests` holds (digest, doc_id) of all rows.

    A text travels if its digest may be repeated, which a bit table of fixed size tells beside the scan.
    """
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    repeated = staged(groups.where("least < most").select("digest", "n"), "audit-repeated")
    # at most SHARES digests hold more than 1 / SHARES of the rows
    total = digests.agg(F.count("*")).scalar()
    entries = repeated.where(F.col("n") * SHARES > total).agg(F.collect_list(F.struct("digest", F.ceil(F.col("n") * SHARES / total).cast("int").alias("blocks"))).alias("e"))
    blocks = F.coalesce(F.element_at(entries.select(F.map_from_entries("e")).scalar(), F.col("digest")), F.lit(1))
    rows = named(docs).where(perhaps_in(bit_table(repeated, F.xxhash64("digest"), BITS), F.xxhash64("digest"), BITS))
    first = rows.groupBy("digest", "text").agg(F.min("doc_id").alias("first"))
    first = first.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(*[F.col(c).alias(f"_{c}") for c in ("digest", "text", "block", "first")])
    later = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    same = (F.col("digest") == F.col("_digest")) & (F.col("text") == F.col("_text")) & (F.col("block") == F.col("_block"))
    return later.join(first, same & (F.col("_first") < F.col("doc_id")), "left_semi").select("doc_id", "part", "digest")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, n_good, n_toxic): documents per part and set of failed filters (a bit mask)."""
    rows = staged(named(docs).select("doc_id", "part", "digest", text_failures(F.col("text")).alias("failed")), "audit-rows")
    copied = copies(docs, rows.select("digest", "doc_id")).select("doc_id", "part", "digest", F.lit(BIT["E"]).alias("failed"), F.lit(0).alias("row"))
    united = rows.withColumn("row", F.lit(1)).unionByName(copied)
    marked = united.groupBy("doc_id", "part", "digest").agg(F.bit_or("failed").alias("failed"), F.sum("row").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    # null ids have no labels; the second key spreads them
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).otherwise(-1)
    joined = marked.withColumn("_spread", spread).join(said.withColumn("_none", F.lit(-1).cast("long")), (F.col("doc_id") == F.col("_id")) & (F.col("_spread") == F.col("_none")), "left")
    n = F.col("n")
    return joined.groupBy("part", "failed").agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("n_toxic"))


def steps() -> Column:
    """All (filter_order, step, bit, earlier): the filter of the step and the mask of those before it."""
    found = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, name in enumerate(order, 1):
            found.append({"filter_order": "".join(order), "step": step, "bit": BIT[name], "earlier": earlier})
            earlier |= BIT[name]
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order string, step int, bit int, earlier int>>")


def report(combos: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of the bit combinations (at most 32 rows a part)."""
    rows = combos.select("*", F.explode(steps()).alias("s")).select("*", "s.*")
    failed, bit, earlier = F.col("failed"), F.col("bit"), F.col("earlier")
    fails, before = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(earlier) != 0
    removed = fails & ~before

    def total(test: Column, count: str) -> Column:
        return F.sum(F.when(test, F.col(count)).otherwise(0)).cast("long")

    # of k failed filters each is the first in 120 / k of the orders
    share = F.when(fails, F.col("n") * F.lit(120)).otherwise(0) / F.greatest(F.bit_count(failed), F.lit(1))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~before, "n").alias("kept"),
        total(removed, "n").alias("removed"),
        total(fails & before, "n").alias("redundant"),
        total(failed == bit, "n").alias("unique_fails"),
        total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"),
        F.sum(share.cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole report of the filters over the documents."""
    return report(combinations(docs, labels))


SQL = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
f as (select doc_id, part,
    case when len(w) < 200 then 1 else 0 end | case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    | case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) then 4 else 0 end
    | case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end | case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as failed
  from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
c as (select part, failed, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from f left join l using (doc_id) group by all),
names as (select unnest(['A', 'B', 'C', 'D', 'E']) as name, unnest([1, 2, 4, 8, 16]) as bit),
orders as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from names a, names b, names c, names d, names e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step, unnest(bits) as bit, unnest([0, bits[1], bits[1] | bits[2], bits[1] | bits[2] | bits[3], 31 - bits[5]]) as earlier from orders),
r as (select part, filter_order, cast(step as integer) as step, bit,
    sum(case when failed & (bit | earlier) = 0 then n else 0 end) as kept, sum(case when failed & bit <> 0 and failed & earlier = 0 then n else 0 end) as removed,
    sum(case when failed & bit <> 0 and failed & earlier <> 0 then n else 0 end) as redundant, sum(case when failed = bit then n else 0 end) as unique_fails,
    sum(case when good and failed & bit <> 0 and failed & earlier = 0 then n else 0 end) as good_lost,
    sum(case when toxic and failed & bit <> 0 and failed & earlier = 0 then n else 0 end) as toxic_lost
  from c, s group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from r
"""


@query("op11_filter_audit", SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction of the five filters over all documents."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
