"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go, largest first, to the
least-loaded shard, found through a heap.

The driver sees a bounded number of units. A group that holds more than one part in ``UNITS`` of
all bytes is a unit of its own; there are fewer than ``UNITS`` such groups, whatever the size of
the input. The other groups are dealt by hash into at most ``UNITS`` bundles. The heap runs over
groups and bundles together, so that the shards differ by about the smallest units. Both lists
are sent to the executors; their size is bounded by ``UNITS`` too.

Defined results: a null text counts as empty and has size 1. Slots count the rows of a shard from
0 without gaps, by (a hash of the row, doc_id, digest); rows that repeat both id and text get
slots in any order. A group larger than a shard's share makes its shard larger: groups are never
split. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, written

UNITS, BUCKET_ROWS = 1 << 16, 20_000


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit; ties go to the earlier unit and the lower shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = [0] * len(sizes)
    for unit in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heap[0]
        out[unit] = shard
        heapq.heapreplace(heap, (load + sizes[unit], shard))
    return out


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, digest, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = written(
        text_rows(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")),
        "sizes",
    )
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = total // UNITS
    bundle = F.pmod(F.xxhash64("digest"), F.lit(UNITS)).cast("int")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    large = sorted((-x[1], bytes(x[0])) for x in groups.where(F.col("bytes") > least).collect())  # fewer than UNITS
    small = sorted((-x[1], x[0]) for x in groups.where(F.col("bytes") <= least).groupBy(bundle.alias("bundle")).agg(F.sum("bytes")).collect())  # UNITS at most
    dealt = longest_first([-x[0] for x in large] + [-x[0] for x in small], shards)
    of_group = spark.createDataFrame([(bytearray(d), s) for (_, d), s in zip(large, dealt, strict=False)], "digest binary, group_shard int")
    of_bundle = spark.createDataFrame([(b, s) for (_, b), s in zip(small, dealt[len(large) :], strict=True)], "bundle int, bundle_shard int")
    placed = (
        rows.join(F.broadcast(of_group), "digest", "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(of_bundle), "bundle", "left")
        .select("doc_id", "size", "text_crc32", "digest", F.coalesce("group_shard", "bundle_shard").alias("shard"))
    )
    buckets = max(1, n_rows // (shards * BUCKET_ROWS) + 1) * 4
    placed = written(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest", "size"), F.lit(buckets)).cast("int")), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    numbered = placed.withColumn("rank", F.row_number().over(order) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
