"""The queries of toxicity and language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_lm, toxicity
from .common import id_remainder, table

THRESHOLD = 0.3


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' toxicity, learnt from labels whose documents are not held out."""
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 4, 2)
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' base and model scores, learnt from those that are not held out."""
    return ngram_lm.scores(table(spark, sf_dir, "documents"), 7, 2)


QUERIES = {"op3_toxicity": op3_toxicity, "op10_lm_scores": op10_lm_scores}
ORACLES: dict[str, str] = {}
