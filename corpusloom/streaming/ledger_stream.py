"""Keep the ledger's latest records as a stream of records arrives.

The batch engine that this one matches has no streams; this is an extra of Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger


def upsert_stream(records: DataFrame, path: str, checkpoint: str, *key: str, recorded: str = "recorded") -> StreamingQuery:
    """Write every micro-batch's latest records under ``path/batch=<n>``; read them with :func:`current`.

    A batch that is replayed overwrites its own folder, so the sink is idempotent.
    """

    def write(batch: DataFrame, n: int) -> None:
        ledger.latest(batch, *key, recorded=recorded).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, *key: str, recorded: str = "recorded") -> DataFrame:
    """The latest record of each key over all batches."""
    return ledger.latest(spark.read.parquet(path), *key, recorded=recorded)
