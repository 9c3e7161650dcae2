"""The queries of packing and byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, packing
from .common import table

SEQUENCE, END_ID = 2048, 0


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"), END_ID, SEQUENCE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op1_packing": op1_packing, "op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
