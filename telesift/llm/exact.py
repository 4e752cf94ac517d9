"""Exact deduplication by content-defined chunk recipes; DataFrame operations only.

Every text is cut where its own content says so (after a sentence or line end, once a least length is reached). A chunk
is named by a 64-bit hash. The distinct chunks are verified by SHA-256: if two different chunks share a hash, they get
different ordinals, so an identifier (hash, ordinal) stands for exactly one chunk. A text is then the ordered list of
its chunk identifiers, and texts are equal where the lists are. Only identifiers move, never the texts.

Defined results: a null text counts as empty, and the empty text is the empty recipe; a null id never stays while its
group has another id; an empty table gives no rows; repeated rows count as members of their group; further columns of
the input are ignored (`recipes`, `duplicates`) or kept (`kept_documents`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import read, settled, staged, without
from telesift.llm.registry import query

LEAST_CHUNK, MOST_CHUNK = 1536, 8192


def chunks(text: Column, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> Column:
    """Content-defined chunks whose concatenation is the text: least..most characters, cut after `. `, `! `, `? ` or a line end."""
    cut = rf"(?s).{{{least}}}.{{0,{most - least - 2}}}?(?:[.!?][ \n]|\n|\z)|(?s).{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered identifiers of the chunks of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.transform(chunks(text), lambda c: F.struct(F.xxhash64(c).alias("h"), F.sha2(c, 256).alias("digest")))
    cut = staged(docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), named.alias("parts")), "chunks")
    distinct = cut.select(F.explode("parts").alias("p")).select("p.h", "p.digest").distinct()
    # by the birthday bound N distinct chunks share 64-bit hashes N*N / 2**65 times: this map is all but empty
    clash = distinct.groupBy("h").agg(F.sort_array(F.collect_set("digest")).alias("digests")).where(F.size("digests") > 1)
    ordinal = clash.select(F.posexplode("digests").alias("ordinal", "digest"))
    clashes = ordinal.agg(F.map_from_entries(F.collect_list(F.struct("digest", "ordinal"))).alias("m")).scalar()
    cut = cut.withColumn("_clashes", clashes)
    named = F.transform("parts", lambda p: F.struct(p.h.alias("h"), F.coalesce(F.element_at(F.col("_clashes"), p.digest), F.lit(0)).alias("ordinal")))
    return cut.select("doc_id", "text_sha256", named.alias("recipe"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row; the largest id of equal texts stays."""
    rows = recipes(docs)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1").withColumnRenamed("recipe", "_recipe")
    out = rows.join(groups, F.col("recipe") == F.col("_recipe"), "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row for each distinct text."""
    found = settled(lambda: duplicates(docs), "duplicates")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    # rows that are repeated with their id are taken out as well, and one of each is put back: only these few move
    twice = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_sha256")
    twice = staged(twice, "repeated-rows")
    gone = staged(found.where(~F.col("kept")).select("doc_id", "text_sha256").unionByName(twice).distinct(), "dropped-rows")
    again = without(docs, twice, F.col("doc_id"), digest, how="left_semi").dropDuplicates(["doc_id", "text"])
    return without(docs, gone, F.col("doc_id"), digest).unionByName(again)


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


@query("op5_exact_dedup", SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return duplicates(read(spark, sf_dir, "documents"))
