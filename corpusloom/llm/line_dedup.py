"""Line deduplication by range-partitioned hashes, returning keep bitmaps instead of text.

Every line becomes (hash of its key, document, position). These rows, without text, are range
partitioned by (hash, document) and sorted within each partition by (hash, document, position),
so that the lines of one key stand together and a very common key spreads over several
partitions. One pass streams each partition and decides key by key. A key whose lines may
continue in a neighbouring partition is decided there and then if it has reached the threshold;
otherwise its few lines wait for the sum over the partitions, at most two keys for each.

The decisions are gathered per document into a compressed bitmap (zlib over packed bits, 1 for a
line that stays). A document without a dropped line has none: null says that all lines stay.

Two rules: ``min_docs=n`` drops every line whose key stands in at least ``n`` documents;
``keep_first=True`` drops every line but the first occurrence of its key, by document and
position.

Defined results: a null or empty text is one empty line. The documents that hold a key are counted by
id: rows that repeat an id count once together, and so do all rows without an id. Bitmaps are kept by
(id, text), so every row gets its own lines. Keys shorter than ``min_chars`` code points always stay.
An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, shuffle_partitions, text_rows, written

UPPER, LOWER, STRIPPED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"
DROP, OPEN, SUM = 0, 1, 2
_OUT = "kind int, h1 long, h2 long, doc_id long, text_hash long, pos int, n_lines int, n_docs long"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_rows(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


def _rows(kind: int, part: dict[str, np.ndarray], n_docs: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(part["h1"])
    ids = part["doc_id"]
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(part["h1"]), pa.array(part["h2"]), pa.array(ids, mask=part["null"]), pa.array(part["text_hash"]), pa.array(part["pos"]), pa.array(part["n_lines"])]
    columns.append(pa.array(np.zeros(n, np.int64) if n_docs is None else n_docs))
    return pa.RecordBatch.from_arrays(columns, names=["kind", "h1", "h2", "doc_id", "text_hash", "pos", "n_lines", "n_docs"])


_NAMES = ("h1", "h2", "doc_id", "null", "text_hash", "pos", "n_lines")


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "text_hash", "pos", "n_lines")}
    out["null"] = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
    out["doc_id"] = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
    return out


def _take(part: dict[str, np.ndarray], where) -> dict[str, np.ndarray]:
    return {c: part[c][where] for c in _NAMES}


def _join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in _NAMES}


def _streamed(min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over one sorted partition for the rule ``min_docs``.

    Held back at any time: the last key's lines while they stand in fewer than ``min_docs``
    documents; once there are so many, its lines flow out as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # undecided lines of the last key
        key, docs, last, first_run = None, 0, None, True  # of the last key: documents so far, last document
        for batch in batches:
            if not batch.num_rows:
                continue
            part = _columns(batch)
            n = len(part["h1"])
            new_key = np.ones(n, bool)
            new_key[1:] = (part["h1"][1:] != part["h1"][:-1]) | (part["h2"][1:] != part["h2"][:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= (part["doc_id"][1:] != part["doc_id"][:-1]) | (part["null"][1:] != part["null"][:-1])
            goes_on = key == (part["h1"][0], part["h2"][0])
            if goes_on:
                new_doc[0] = last != (part["doc_id"][0], part["null"][0])
            elif key is not None:
                if first_run or docs >= min_docs:
                    yield from _closed(key, docs, held, first_run, min_docs)
                held, first_run = None, False
            starts = np.flatnonzero(new_key)
            totals = np.add.reduceat(new_doc.astype(np.int64), starts)
            if goes_on:
                totals[0] += docs
            ends = np.append(starts[1:], n)
            tail = slice(starts[-1], n)
            if len(starts) > 1:
                if goes_on or key is None:  # the first key of the batch is complete, perhaps with held lines
                    lines = _take(part, slice(0, ends[0]))
                    lines = _join([held, lines]) if held is not None and goes_on else lines
                    first_key = (part["h1"][0], part["h2"][0])
                    if totals[0] >= min_docs:
                        yield _rows(DROP, lines)
                    elif first_run:
                        yield _rows(OPEN, lines)
                    if first_run:
                        yield _sum(first_key, int(totals[0]))
                    inner, held, first_run = slice(1, len(starts) - 1), None, False
                else:
                    inner = slice(0, len(starts) - 1)
                drop = np.zeros(len(starts), bool)
                drop[inner] = totals[inner] >= min_docs
                mask = np.repeat(drop, ends - starts)
                if mask.any():
                    yield _rows(DROP, _take(part, mask))
                goes_on = False
            key, docs = (part["h1"][-1], part["h2"][-1]), int(totals[-1])
            last = (part["doc_id"][-1], part["null"][-1])
            lines = _take(part, tail)
            lines = _join([held, lines]) if held is not None and goes_on else lines
            held = None
            if docs >= min_docs:
                yield _rows(DROP, lines)
            else:
                held = lines
        if key is not None:
            yield from _closed(key, docs, held, True, min_docs)

    return run


def _sum(key: tuple[int, int], docs: int) -> pa.RecordBatch:
    one = {"h1": np.array([key[0]]), "h2": np.array([key[1]]), "doc_id": np.zeros(1, np.int64), "null": np.array([True]), "text_hash": np.zeros(1, np.int64), "pos": np.zeros(1, np.int32), "n_lines": np.zeros(1, np.int32)}
    return _rows(SUM, one, np.array([docs], np.int64))


def _closed(key: tuple[int, int], docs: int, held: dict | None, at_edge: bool, min_docs: int) -> Iterator[pa.RecordBatch]:
    """What is left to say of a key: held lines wait at an edge of the partition; its documents are reported there."""
    if at_edge:
        if held is not None and docs < min_docs:
            yield _rows(OPEN, held)
        yield _sum(key, docs)


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, pos, n_lines) of every line that goes."""
    spark = docs.sparkSession
    lines = _documents(docs, id_col, text_col).select("doc_id", "text_hash", F.split("text", "\n").alias("lines")).select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    # Written, as finding the bounds of the ranges reads the rows once more.
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos", "n_lines")
    order = ["h1", "h2", "doc_id"]
    hashed = written(hashed, "line-hashes")
    dealt = hashed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text_hash", "pos")
    if keep_first:
        found = written(dealt.mapInArrow(_all_but_first, "h1 long, h2 long, doc_id long, text_hash long, pos int, n_lines int, opens boolean"), "firsts")
        removed(hashed)
        # Only the first line of a partition may continue a key; the smallest of those that open a key stays.
        least = found.where("opens").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("least"))
        opened = found.where("opens").join(least, ["h1", "h2"]).where(F.struct("doc_id", "text_hash", "pos") != F.col("least"))
        return found.where("not opens").select("doc_id", "text_hash", "pos", "n_lines").unionByName(opened.select("doc_id", "text_hash", "pos", "n_lines")).distinct()
    found = written(dealt.mapInArrow(_streamed(min_docs), _OUT), "line-runs")
    removed(hashed)
    reached = found.where(F.col("kind") == SUM).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    waiting = found.where(F.col("kind") == OPEN).join(reached, ["h1", "h2"])
    columns = ["doc_id", "text_hash", "pos", "n_lines"]
    return found.where(F.col("kind") == DROP).select(*columns).unionByName(waiting.select(*columns)).distinct()


def _all_but_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pass for ``keep_first``: first occurrences stream through as ``opens``, later ones go."""
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = _columns(batch)
        n = len(part["h1"])
        opens = np.ones(n, bool)
        opens[1:] = (part["h1"][1:] != part["h1"][:-1]) | (part["h2"][1:] != part["h2"][:-1])
        opens[0] = key != (part["h1"][0], part["h2"][0])
        key = (part["h1"][-1], part["h2"][-1])
        out = _rows(DROP, part)
        yield pa.RecordBatch.from_arrays([*(out[c] for c in ("h1", "h2", "doc_id", "text_hash", "pos", "n_lines")), pa.array(opens)], names=["h1", "h2", "doc_id", "text_hash", "pos", "n_lines", "opens"])


def packed(dropped: list[int], n_lines: int) -> bytes:
    """The keep bitmap of a document."""
    bits = np.ones(n_lines, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    """One boolean per line: whether it stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines = batch["n_lines"].to_pylist()
        maps = [packed(pos, n) for pos, n in zip(batch["dropped"].to_pylist(), n_lines, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], batch["n_lines"], pa.array(map(len, batch["dropped"].to_pylist()), pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, bitmap) of every document that loses a line."""
    gone = dropped_lines(docs, min_docs, min_chars, keep_first, id_col, text_col)
    per_doc = gone.groupBy("doc_id", "text_hash").agg(F.first("n_lines").alias("n_lines"), F.collect_list("pos").alias("dropped"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines int, n_dropped long, bitmap binary")


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, bitmap in zip(batch["text"].to_pylist(), batch["bitmap"].to_pylist(), strict=True):
            if bitmap is not None:
                lines = text.split("\n")
                text = "\n".join(line for line, stays in zip(lines, unpacked(bitmap, len(lines)), strict=True) if stays)
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_lines"], batch["n_dropped"], pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def without_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row: the bitmaps applied to the texts."""
    maps = written(keep_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col), "bitmaps").select(F.col("doc_id").alias("map_id"), F.col("text_hash").alias("map_hash"), "n_dropped", "bitmap")
    rows = _documents(docs, id_col, text_col)
    # Always by sorted shuffle, so that the plan is the same at every size.
    joined = rows.join(maps.hint("merge"), (rows.text_hash == maps.map_hash) & rows.doc_id.eqNullSafe(maps.map_id), "left")
    lines = joined.select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "bitmap")
    return lines.mapInArrow(_kept_text, "doc_id long, n_lines long, n_dropped long, kept_text string")
