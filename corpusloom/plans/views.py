"""Views of the driver's tables in the shape of the engine's data model, in Spark and in DuckDB.

The text of a view is the same SQL for both engines where they agree; where they do not (lines of
a text), each has its own. ``SQL[name]`` is the DuckDB form, to stand in a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CORPUS = """
select source || ':' || cast(d.doc_id as string) as id, d.doc_id as ord, case when d.doc_id % 90 = 0 then 'it' else d.lang end as chapter, d.text, d.source,
  case when d.doc_id % 3 <> 0 then upper(d.source) end as school,
  cast(case when d.doc_id % 3 <> 0 then 2019 + d.doc_id % 6 end as int) as year,
  case d.doc_id % 5 when 0 then 'I' when 1 then 'P1' when 2 then 'II' when 3 then 'P2' else 'p 2' end as paper,
  case d.doc_id % 4 when 0 then 'Q11' when 1 then '11' when 2 then '11(a)' else 'Q11(a)' end as question_no,
  case d.doc_id % 7 when 0 then 'Mathematical Induction' when 1 then 'Binomial Thoerem' when 2 then 'Binomial & Poisson Distributions' end as topic,
  case when d.doc_id % 2 = 0 then d.source || '-' || case when d.doc_id % 90 = 0 then 'it' else d.lang end end as source_file,
  case cast(floor(d.doc_id / 7.0) as bigint) % 10 when 8 then 'test' when 9 then 'val' else 'train' end as split,
  l.quality as quality
from documents d left join labels l on d.doc_id = l.doc_id
"""

_PRED = """
select doc_id as ord, lang as y_true,
  case when text like '% the %' then 'en' when text like '% der %' then 'de' when text like '% les %' then 'fr' else 'es' end as predicted_a,
  case when text like '% of %' then 'en' when text like '% und %' then 'de' when text like '% que %' then 'es' when text like '% est %' then 'fr' else 'en' end as predicted_b,
  cast(doc_id * 37 % 101 as double) / cast(100 as double) as confidence
from documents
"""

_LINE_COLUMNS = """
select paper_id, ord, cast(floor(ord / 8.0) as int) as page, cast(842 as double) as page_height,
  cast(case when ord % 3 = 0 then 50 else 90 end as double) as x0, cast(case when ord % 16 = 13 then 40 when ord % 16 = 14 then 800 else 60 + 90 * (ord % 8) end as double) as y0,
  cast(case when ord % 11 = 5 then 5 when ord % 11 = 6 then null else 11 end as double) as size,
  case when ord % 3 = 0 then cast(cast(floor(ord / 3.0) as int) + 1 as string) || '. ' || line
       when ord % 17 = 16 then 'Section B ' || line else line end as text
from raw_lines
"""

_LEDGER = """
select event_id, event_type as approach, cast(42 + user_id % 3 as int) as seed,
  case event_id % 4 when 0 then 0.25e0 when 1 then 0.5e0 when 2 then 0.75e0 else 1.0e0 end as fraction,
  ts as recorded, case when event_id % 5 = 0 then 'old' else 'new' end as test_hash,
  event_id % 7 < 4 as class_weights, cast(case when event_id % 3 = 0 then 256 else 512 end as int) as max_tokens,
  cast(200 + event_id % 40 as bigint) as correct, cast(246 as int) as test_rows, value
from events
"""

_RAW_DUCKDB = "select doc_id as paper_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as ord from (select doc_id, string_split(text, chr(10)) as lines from documents)"

SQL = {
    "corpus": _CORPUS,
    "pred": _PRED,
    "raw_lines": _RAW_DUCKDB,
    "lines": _LINE_COLUMNS,
    "ledger": _LEDGER,
    "langs": "select * from (values (0, 'de', 'German'), (1, 'en', 'English'), (2, 'es', 'Spanish'), (3, 'fr', 'French'), (4, 'it', 'Italian')) t(class_id, slug, name)",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CORPUS.replace("from documents d", "from {documents} d").replace("join labels l", "join {labels} l"), documents=_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels"))


def pred(spark: SparkSession, sf_dir: str, side: str = "a") -> DataFrame:
    both = spark.sql(_PRED.replace("from documents", "from {documents}"), documents=_table(spark, sf_dir, "documents"))
    return both.select("ord", "y_true", F.col(f"predicted_{side}").alias("predicted"), "confidence")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return spark.sql(_LINE_COLUMNS.replace("from raw_lines", "from {raw}"), raw=raw.withColumn("ord", F.col("ord").cast("long")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, page of every page."""
    last = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.floor((F.size(F.split("text", "\n")) - 1) / 8.0).cast("int").alias("last")).where("last is not null")
    return last.select("paper_id", F.explode(F.sequence(F.lit(0), "last")).alias("page"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(_LEDGER.replace("from events", "from {events}"), events=_table(spark, sf_dir, "events"))
    return found.withColumn("conditions", F.struct("class_weights", "max_tokens"))


def langs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "de", "German"), (1, "en", "English"), (2, "es", "Spanish"), (3, "fr", "French"), (4, "it", "Italian")], "class_id int, slug string, name string")


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views before it; ``sql`` may begin with a WITH clause of its own."""
    order = [n for n in SQL if n in names or (n == "raw_lines" and "lines" in names)]
    head = ", ".join(f"{n} as ({SQL[n]})" for n in order)
    body = sql.strip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with"):
        body = body[len("with recursive") if recursive else len("with") :].strip()
        return f"with {'recursive ' if recursive else ''}{head}, {body}"
    return f"with {head} {body}"
