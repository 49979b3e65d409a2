"""Exact dedup over an extendible-hash index in the shared folder; DataFrame operations only.

A key is the 64-bit hash of a text. The directory has 2**depth cells, one per leading bit pattern of the key; several
cells point to one bucket while their keys fit in it. Doubling the directory splits only overfull buckets.
A bucket is a contiguous range of keys with a bounded number of entries, so its owner task is bounded too.
Equal keys chain: entries of one key are told apart by comparing the texts' bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.shared import stored, whole_text

#: Entries in a bucket before it splits.
CAPACITY = 1024
#: Doublings past the depth at which the mean bucket is full. Keys still together then share their leading bits and chain.
EXTRA_DOUBLINGS = 6


def cell_of(key: Column, depth: int) -> Column:
    """The directory cell of a key: its leading ``depth`` bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``(cells, depth)`` for distinct keys ``key``: cells has ``cell``, ``local_depth`` and ``bucket``, one row per used cell.

    The directory doubles until no bucket is overfull; only two numbers a doubling reach the driver. A bucket's
    ``local_depth`` is the least number of leading bits at which its keys fit, and ``bucket`` is those bits behind a leading 1.
    No keys: no cells, depth 0. Keys that many doublings do not part stay together in an overfull bucket.
    """
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1.0, total / capacity))))
    last = min(62, depth + EXTRA_DOUBLINGS)
    while True:
        cells = keys.groupBy(cell_of(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("entries"))
        fullest = cells.agg(F.max("entries")).first()[0] or 0
        if fullest <= capacity or depth >= last:
            break
        depth += 1
    cells = stored(cells)
    levels = cells.select("cell", "entries", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)"))
    fits = levels.groupBy("level", "prefix").agg(F.sum("entries").alias("held")).filter((F.col("held") <= capacity) | (F.col("level") == depth))
    placed = levels.join(fits, ["level", "prefix"]).groupBy("cell").agg(F.min("level").alias("local_depth"))
    bucket = F.expr(f"shiftright(cell, {depth} - local_depth) + shiftleft(1L, local_depth)")
    return placed.withColumn("bucket", bucket), depth


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The index, written to the shared folder: ``bucket, local_depth, key, chain, text_sha256, keep_id, group_size``.

    One row per distinct text. Copies are folded before they move, so a text with a third of all rows costs one row
    per task. ``chain`` numbers different texts of one key from 0. ``keep_id`` is the largest doc_id, null if all are null.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("body")).withColumn("key", F.xxhash64("body"))
    entries = keyed.groupBy("key", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    entries = stored(entries.select("key", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))
    cells, depth = directory(entries.select("key").distinct(), capacity)
    entries = entries.withColumn("cell", cell_of(F.col("key"), depth)).join(cells, "cell")
    chained = entries.withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("text_sha256")) - 1)
    owned = chained.repartition("bucket").sortWithinPartitions("bucket", "key", "chain")
    return stored(owned.select("bucket", "local_depth", "key", "chain", "text_sha256", "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts form a group; the row with the largest doc_id stays. Null texts count as empty and are equal to empty ones.
    Rows that repeat a whole (doc_id, text) pair count in ``group_size`` and are all marked kept, as nothing tells them apart.
    Null doc_ids lose to any other; a group of nulls only has a null ``keep_id`` and is kept. An empty table gives no rows.
    Other columns are not read.
    """
    index = build_index(docs, text, doc_id, capacity).select("key", "text_sha256", "keep_id", "group_size")
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("body")).select("doc_id", F.xxhash64("body").alias("key"), F.sha2("body", 256).alias("text_sha256"))
    found = rows.join(index, ["key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
