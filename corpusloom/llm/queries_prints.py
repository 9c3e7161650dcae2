"""The query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import table, written

RADIUS = 3


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, their likeness to the edited text and the next document; for every 50th id, how many documents lie within the radius."""
    rows = written(simhash.edited_fingerprints(table(spark, sf_dir, "documents")), "edited")
    own, edited, following = ((F.col(f"{x}_a"), F.col(f"{x}_b")) for x in ("fp", "ed", "next"))
    copies = rows.groupBy("fp_a", "fp_b").agg(F.count("*").alias("copies"))
    found = simhash.within(rows.where("doc_id % 50 = 0"), copies, RADIUS)
    near = found.join(copies, ["fp_a", "fp_b"]).groupBy("q_a", "q_b").agg(F.sum("copies").alias("near_docs"))
    asked = rows.join(near, (rows.fp_a == near.q_a) & (rows.fp_b == near.q_b) & (rows.doc_id % 50 == 0), "left")
    return asked.select("doc_id", "n_chars", "edited_sha256", simhash.as_text(*own).alias("fingerprint"), simhash.as_text(*edited).alias("edited_fingerprint"), simhash.likeness(own, edited).alias("near_edited"), simhash.likeness(own, following).alias("near_next"), "near_docs")


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLES: dict[str, str] = {}
