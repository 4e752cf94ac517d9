"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce, wraps
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telesift.session import scratch_path

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_collected: list[list[DataFrame]] = []


@contextmanager
def collecting():
    """The tables that are staged meanwhile and not released yet, as a list."""
    made: list[DataFrame] = []
    _collected.append(made)
    try:
        yield made
    finally:
        _collected.pop()
        if _collected:
            _collected[-1].extend(made)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from its files; released() takes it away again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.staged_at = path
    if _collected:
        _collected[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that `make` returns, staged; all that was staged on the way to it is released."""
    with collecting() as made:
        out = staged(make(), name)
        released(*[t for t in made if t is not out])
    return out


def released(*tables: DataFrame) -> None:
    """Delete staged tables that no later result reads (their readers have been written themselves)."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        for made in _collected:
            made[:] = [m for m in made if m is not t]


BITS = 1 << 24  # size of a bit table: 2 MB


def bit_table(keys: DataFrame, hashed: Column, bits: int = BITS) -> Column:
    """A bit for the hash of every key, as one array of `bits` / 64 numbers whatever the number of keys."""
    at = F.pmod(hashed, F.lit(bits))
    places = keys.select(at.alias("at")).selectExpr("at div 64 as id", "shiftleft(1L, cast(at % 64 as int)) as bit").groupBy("id").agg(F.bit_or("bit").alias("bits"))
    dense = keys.sparkSession.range(bits // 64).join(places, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    return dense.select(F.col("all.bits")).scalar()


def perhaps_in(table: Column, hashed: Column, bits: int = BITS) -> Column:
    """False if the hash is surely not that of a key; as keys grow it only tells less, and the join behind it stays exact."""
    at = F.pmod(hashed, F.lit(bits))
    return F.getbit(F.element_at(table, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def keep_rate(counted: int, most: int) -> float:
    """Share of rows by which a hash draw keeps about `most` of the counted ones."""
    return 1.0 if counted <= most else most / counted


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one struct `row` beside key columns, so that no name of the input can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def without(docs: DataFrame, gone: DataFrame, *keys: Column, how: str = "left_anti") -> DataFrame:
    """The rows whose keys are not among those of `gone` (its columns, in order); null equals null.

    `gone` is a staged table. Rows that a bit table tells are surely not in it stay where they are; the others are joined.
    """
    table = bit_table(gone, F.xxhash64(*gone.columns))
    gone = gone.toDF(*[f"gone{i}" for i in range(len(keys))])
    same = reduce(and_, [F.col(f"key{i}").eqNullSafe(F.col(f"gone{i}")) for i in range(len(keys))])
    rows = packed(docs, **{f"key{i}": k for i, k in enumerate(keys)})
    perhaps = perhaps_in(table, F.xxhash64(*[f"key{i}" for i in range(len(keys))]))
    joined = rows.where(perhaps).join(gone, same, how).select("row.*")
    return joined if how == "left_semi" else joined.unionByName(rows.where(~perhaps).select("row.*"))


def ordinals(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Global row number (from 0) in the given order without gathering the rows in one task.

    Rows are range-partitioned and written; the counts of the parts (one number per part) give each part its offset.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordinals")
    offsets, total = [], 0
    for part, n in sorted((r._part, r.n) for r in laid.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, total))
        total += n
    start = spark.createDataFrame(offsets, "_part int, _start long")
    numbered = laid.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return numbered.join(start, "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable) -> Callable:
    """A task function after which freed memory goes back to the system: Python workers live on, and the stages of a job
    share a machine's memory with them."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return task


def portions(batches, column: str = "text", most: int = 4_000_000):
    """Arrow batches cut to about `most` bytes of the column (one row at least), so that a task's memory stays bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(first, last - first)
            first = last
