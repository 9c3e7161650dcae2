"""TF-IDF with sublinear counts and smoothed frequencies, in long form and as vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..tables import written

#: The vocabulary keeps so many terms, those of two documents at least.
MAX_FEATURES, MIN_DF = 20_000, 2
#: Different terms that one task counts before it passes them on.
FLUSH = 500_000
#: Counts of a chunk of the long form, and rows that it gives at a time.
CHUNK, OUT = 1_000_000, 100_000
_ASCII_WORD = re.compile("[a-z0-9_]{2,}")
_CHUNK = "chunk long, rows binary, keys binary, lengths binary, index binary, n binary, terms array<string>, df array<long>"
_CHUNK_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Without combining marks, by compatibility decomposition."""
    import unicodedata

    def plain(s: str) -> str:
        return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return text.map(plain, na_action="ignore")


def tokens(text: Column) -> Column:
    """Words of two characters or more, of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """Words, then pairs of adjacent words."""
    pairs = F.transform(F.arrays_zip(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b")), lambda x: F.concat(x["a"], F.lit(" "), x["b"]))
    return F.concat(words, pairs)


def words(text: str = "text") -> Column:
    """The words that the classifier reads: normalised, without accents."""
    return tokens(strip_accents(tx.normalise_question(text)))


def prepared(rows: DataFrame, text: str = "text", out: str = "terms") -> DataFrame:
    """``rows`` with the terms that the classifier reads: words, with bigrams."""
    return rows.withColumn("_words", words(text)).withColumn(out, with_bigrams(F.col("_words"))).drop("_words")  # a column of its own, so that each text is cut once


def terms_of(words: list[str]) -> list[str]:
    """:func:`with_bigrams` in Python."""
    return words + [f"{a} {b}" for a, b in pairwise(words)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n, df of rows of words, summed over as many rows as give FLUSH terms."""
    n, df = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["term", "n", "df"])

    for batch in batches:
        for row in batch.column(0):
            own = terms_of(row.as_py())
            n.update(own)
            df.update(set(own))
            if len(n) >= FLUSH:
                yield flush()
                n, df = Counter(), Counter()
    yield flush()


def vocabulary(rows: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """term, n, df of the most frequent terms of ``words``, in order; of equally frequent ones, the first by code points."""
    sums = rows.select("words").mapInArrow(_counted, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return sums.where(F.col("df") >= min_df).orderBy(F.col("n").desc(), "term").limit(max_features)


def _chunked(columns: list[str], key: str):
    """Chunks of rows (key and columns, word counts, dictionary) of rows sorted by all columns, the text last; no key is in two chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, at = TaskContext.get().partitionId(), 0, columns.index(key)
        places: dict[str, int] = {}
        rows, lengths, keys, index, n, df = [], [], [], [], [], Counter()

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches([x for x in rows if x.num_rows])
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            packed = [np.array(x, np.int32).tobytes() for x in (keys, lengths)] + [np.concatenate(x or [np.zeros(0)]).astype(np.int32).tobytes() for x in (index, n)]
            values = [[(task << 32) + made], [sink.getvalue().to_pybytes()], *[[x] for x in packed], [list(places)], [[df[i] for i in range(len(places))]]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], _CHUNK_NAMES)

        last, own, counts, size = None, None, Counter(), 0  # the rows that are equal in all columns, of which the batch may hold a part

        def close() -> None:
            nonlocal size, counts
            if own is not None:
                found = np.fromiter((places.setdefault(t, len(places)) for t in counts), np.int64, len(counts))
                df.update(found.tolist())
                index.append(found)
                n.append(np.fromiter(counts.values(), np.int64, len(counts)))
                lengths.append(len(found))
                size += len(found)
            counts = Counter()

        for batch in batches:
            every = [batch.column(i).to_pylist() for i in range(len(columns))]
            taken = []
            for i, text in enumerate(batch.column(len(columns)).to_pylist()):
                row = tuple(c[i] for c in every)
                if own != row:
                    close()
                    if own is not None and row[at] != last and size >= CHUNK:
                        rows.append(batch.select(columns).take(pa.array(taken, pa.int64())))
                        yield chunk()
                        made, size, taken = made + 1, 0, []
                        places.clear(), df.clear(), rows.clear(), lengths.clear(), keys.clear(), index.clear(), n.clear()
                    keys.append((keys[-1] + (row[at] != last)) if keys else 0)
                    own, last = row, row[at]
                    taken.append(i)
                counts.update(_ASCII_WORD.findall(text))
            rows.append(batch.select(columns).take(pa.array(taken, pa.int64())))
        close()
        if keys:
            yield chunk()

    return run


def _weighed(names: list[str], total: int):
    """The columns, term and tfidf of chunks with the document frequencies of their dictionaries, 0 for those that are too low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = {k: batch.column(k)[at] for k in batch.schema.names}
                table = pa.ipc.open_stream(one["rows"].as_buffer()).read_all().combine_chunks()
                keys, lengths, index, n = (np.frombuffer(one[k].as_buffer(), np.int32) for k in ("keys", "lengths", "index", "n"))
                df = np.zeros(len(one["terms"]))
                if one["place"].is_valid:
                    df[one["place"].values.to_numpy()] = one["found"].values.to_numpy()
                row, known = np.repeat(np.arange(len(lengths)), lengths), df[index] > 0
                row, index, n = row[known], index[known], n[known]
                v = (1.0 + np.log(n)) * (np.log((1.0 + total) / (1.0 + df[index])) + 1.0)
                norm = np.sqrt(np.bincount(keys[row], v * v, keys[-1] + 1))
                v /= norm[keys[row]]
                for i in range(0, len(v), OUT):
                    part = slice(i, i + OUT)
                    own = table.take(pa.array(row[part])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*[own.column(c).combine_chunks() if own.num_rows else own.column(c) for c in names], one["terms"].values.take(pa.array(index[part])), pa.array(v[part])], [*names, "term", "tfidf"])

    return run


def long_tfidf(rows: DataFrame, key: str, text: str = "text", min_df: int = MIN_DF) -> DataFrame:
    """The other columns with term and tfidf: ASCII unigrams, (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), of unit length per row.

    Texts are shuffled once, by key; a chunk of them holds its counts and each of its words once.
    Only words of chunks are shuffled for frequencies, never the words of each text.
    """
    columns = [c for c in rows.columns if c != text]
    total = rows.count()
    lower = rows.select(*columns, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    dealt = lower.repartition(key).sortWithinPartitions(key, *[c for c in columns if c != key])
    chunks = written(dealt.mapInArrow(_chunked(columns, key), _CHUNK), "tfidf-chunks")
    asked = chunks.select("chunk", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("terms") - 1).alias("place"), F.col("terms").alias("term"), F.col("df").alias("df"))).alias("x")).select("chunk", "x.*").where("term is not null")
    found = asked.select("chunk", "place", F.sum("df").over(Window.partitionBy("term")).alias("found")).where(F.col("found") >= min_df)
    answers = found.groupBy("chunk").agg(F.collect_list(F.struct("place", "found")).alias("x")).select("chunk", F.col("x.place").alias("place"), F.col("x.found").alias("found"))
    joined = chunks.drop("df").join(answers.hint("merge"), "chunk", "left")
    schema = T.StructType([rows.schema[c] for c in columns]).add("term", "string").add("tfidf", "double")
    return joined.mapInArrow(_weighed(columns, total), schema)
