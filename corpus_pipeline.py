"""The training-data pipeline: toxicity, exact dedup, near-duplicate dedup, packing.

Each stage takes all rows that its predecessor kept, is written as Parquet and read again.

Defined results, of all stages: a null text counts as empty; null ids are kept apart from all others, and of
equal or similar texts a row with an id stays before one without; of rows that repeat an id and a text
one stays after exact dedup; further columns are handed on, whatever their names; an empty table gives
an empty table. Without labels of both classes no document is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, near_dedup, packing, toxicity
from corpusloom.llm.common import removed, table, written

THRESHOLD, SEQUENCE, END_ID = 0.3, 2048, 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the smallest id."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), END_ID, SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near-duplicate dedup", drop_near_copies), ("packing", pack)]

#: Scores of a trained network and sampled signatures have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, over all documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            removed(before)
        before = docs
    return docs
