"""The query of near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import near_dedup
from .common import table


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of their near duplicates, similarity 0.8 or more over five words, and their number of verified links."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES: dict[str, str] = {}
