"""What the operators of this subpackage share: input columns, written tables and counts.

Every operator takes a DataFrame with an id column and a text column. It selects those two and
nothing else, so that further columns of the caller, whatever their names, cannot clash. A null
text counts as the empty text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import shared_folder

#: White space of the contracts: the space and the five ASCII controls from tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of every row, a null text as the empty one."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def id_remainder(column: Column | str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo the divisor; a null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` gave back and that nothing reads any more."""
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def one_of_each(docs: DataFrame, keys: dict[str, Column], stays: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``keys`` are among ``stays`` (the same names, no nulls), one for each.

    Whole rows are shuffled once, by all keys; of rows with equal keys any one stays.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])
    kept = packed.join(stays.select(*keys).hint("merge"), list(keys), "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return kept.withColumn("first", first).where("first = 1").select("row.*")


def id_keys(doc_id: Column) -> dict[str, Column]:
    """A doc_id that may be null as two keys that may not."""
    return {"key_id": F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")), "key_null": doc_id.isNull()}
