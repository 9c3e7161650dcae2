"""Exact deduplication by a cuckoo-filter index over live digests.

The digest of a text is the SHA-256 of the text with every run of ASCII white space replaced by
one space. Digests are dealt to shards by their first bytes. Each shard holds a
:class:`CuckooIndex`: a cuckoo filter of 16-bit tags in buckets of four, beside which every slot
names the whole digest that it stands for, so that a tag hit is verified against the content of
its bucket. An insertion that finds no place after a bounded number of moves resizes the filter
from the stored digests. Deletion takes a digest out of its slot.

Rows are pre-aggregated by (digest, salt) before they are shuffled, so that a text that a third
of all rows share reaches its shard as at most ``SALTS`` rows.

Defined results: a null text equals the empty text; of equal texts the row with the smallest
non-null id stays; if all ids of a group are null, ``keep_id`` is null. Of rows that repeat both
the id and the text of the row that stays, :func:`keep_first` keeps one. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, id_keys, one_of_each, shuffle_partitions, text_rows, written

SLOTS, MOVES, SALTS, SHARD_ROWS = 4, 200, 16, 1_000_000


class CuckooIndex:
    """Live digests with a payload (smallest id, rows); exact membership behind a cuckoo filter."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.keep: list[int | None] = []
        self.rows: list[int] = []
        self.free: list[int] = []
        self.live = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.tags = [0] * (buckets * SLOTS)
        self.refs = [-1] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.buckets - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995 >> 3) & (self.buckets - 1))

    def _slot(self, digest: bytes) -> int:
        """The slot whose content is the digest, or -1. A tag alone is never taken for a hit."""
        tag, first, second = self._places(digest)
        tags, refs, keys = self.tags, self.refs, self.keys
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if tags[slot] == tag and keys[refs[slot]] == digest:
                    return slot
        return -1

    def _place(self, digest: bytes, ref: int) -> bool:
        tag, first, second = self._places(digest)
        tags, refs = self.tags, self.refs
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not tags[slot]:
                    tags[slot], refs[slot] = tag, ref
                    return True
        bucket = second
        for move in range(MOVES):
            slot = bucket * SLOTS + (move + tag) % SLOTS
            tag, tags[slot] = tags[slot], tag
            ref, refs[slot] = refs[slot], ref
            bucket = self._other(bucket, tag)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not tags[slot]:
                    tags[slot], refs[slot] = tag, ref
                    return True
        return False

    def _resize(self) -> None:
        """Rebuild a filter of twice the buckets from the stored digests."""
        buckets = self.buckets
        while True:
            buckets *= 2
            self._empty(buckets)
            if all(self._place(key, ref) for ref, key in enumerate(self.keys) if key is not None):
                return

    def add(self, digest: bytes, keep: int | None, rows: int) -> bool:
        """Insert a digest, or merge it with the live one. True if it was new."""
        slot = self._slot(digest)
        if slot >= 0:
            ref = self.refs[slot]
            self.rows[ref] += rows
            if keep is not None and (self.keep[ref] is None or keep < self.keep[ref]):
                self.keep[ref] = keep
            return False
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.keep[ref], self.rows[ref] = digest, keep, rows
        else:
            ref = len(self.keys)
            self.keys.append(digest)
            self.keep.append(keep)
            self.rows.append(rows)
        self.live += 1
        if self.live > self.buckets * SLOTS * 0.9 or not self._place(digest, ref):
            self._resize()
        return True

    def remove(self, digest: bytes) -> bool:
        """Delete a live digest. True if there was one."""
        slot = self._slot(digest)
        if slot < 0:
            return False
        ref = self.refs[slot]
        self.tags[slot], self.refs[slot] = 0, -1
        self.keys[ref] = None
        self.free.append(ref)
        self.live -= 1
        return True

    def get(self, digest: bytes) -> tuple[int | None, int] | None:
        """(smallest id, rows) of a live digest."""
        slot = self._slot(digest)
        return None if slot < 0 else (self.keep[self.refs[slot]], self.rows[self.refs[slot]])

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        return ((k, self.keep[i], self.rows[i]) for i, k in enumerate(self.keys) if k is not None)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text, ASCII_SPACE, " "), 256))


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and digest of every row."""
    return text_rows(docs, id_col, text_col).select("doc_id", digest(F.col("text")).alias("digest"))


def _shards(rows: int, least: int) -> int:
    return max(least, -(-rows // SHARD_ROWS))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: every pre-aggregated row goes through the index; its live digests come out."""
    index = CuckooIndex()
    for batch in batches:
        for key, keep, rows in zip(batch["digest"].to_pylist(), batch["keep_id"].to_pylist(), batch["n"].to_pylist(), strict=True):
            index.add(key, keep, rows)
    kept = list(index.items())
    for at in range(0, len(kept), 50_000):
        part = kept[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int64())], names=["digest", "keep_id", "group_size"]
        )


def groups(rows: DataFrame, n_rows: int) -> DataFrame:
    """(digest, keep_id, group_size) of every distinct digest of ``rows`` (doc_id, digest)."""
    shards = _shards(n_rows, shuffle_partitions(rows.sparkSession))
    partial = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).groupBy("digest", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    dealt = partial.select("digest", "keep_id", "n").repartition(shards, "digest")
    return dealt.mapInArrow(_indexed, "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept."""
    rows = written(digested(docs, id_col, text_col), "digests")
    found = groups(rows, rows.count())
    return rows.join(found, "digest").select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts."""
    rows = written(digested(docs, id_col, text_col), "digests")
    found = groups(rows, rows.count())
    stays = found.select("digest", *[v.alias(k) for k, v in id_keys(F.col("keep_id")).items()])
    return one_of_each(docs, {"digest": digest(F.coalesce(docs[text_col], F.lit(""))), **id_keys(docs[id_col])}, stays)


def build_index(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A live index as a table: shard, digest, keep_id, rows."""
    rows = digested(docs, id_col, text_col)
    return groups(rows, rows.count()).select(_shard("digest", shards).alias("shard"), "digest", "keep_id", F.col("group_size").alias("rows"))


def _shard(column: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")


def update_index(index: DataFrame, docs: DataFrame, shards: int, delete: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index after the texts of ``docs`` are inserted, or their digests deleted, shard by shard.

    The caller keeps ``shards`` in proportion to the digests, about a million each; a shard holds
    each digest of the batch once.
    """
    batch = digested(docs, id_col, text_col).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("rows")).withColumn("shard", _shard("digest", shards))

    def merge(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        live = CuckooIndex()
        integer = lambda x: None if pd.isna(x) else int(x)
        for row in old.itertuples():
            live.add(bytes(row.digest), integer(row.keep_id), int(row.rows))
        for row in new.itertuples():
            if delete:
                live.remove(bytes(row.digest))
            else:
                live.add(bytes(row.digest), integer(row.keep_id), int(row.rows))
        shard = int((old if len(old) else new)["shard"].iloc[0])
        out = pd.DataFrame(list(live.items()), columns=["digest", "keep_id", "rows"])
        out["keep_id"] = out["keep_id"].astype("Int64")
        out.insert(0, "shard", shard)
        return out

    return index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(merge, "shard int, digest binary, keep_id long, rows long")
