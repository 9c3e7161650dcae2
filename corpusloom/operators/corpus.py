"""From extracted rows to the labelled corpus: filter, deduplicate, label, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx

# Topics without a label, the mixed topic, rows whose tag is mistyped, the least length of a text match.
OUTSIDE_TOPICS = ("Mathematical Induction", "Binomial Thoerem")
MIXED_TOPIC = "Binomial & Poisson Distributions"
MISTYPED_PROVENANCE = ("topical-t10-q029", "topical-t13-q011")
MIN_TEXT_MATCH = 40


class CorpusError(ValueError):
    """A corpus that must not be written."""


def drop_reason() -> Column:
    """Why a row has no place in the syllabus; null if it has one."""
    poisson = F.lower(F.coalesce("text", F.lit(""))).contains("poisson")
    return F.when(F.col("topic").isin(*OUTSIDE_TOPICS), F.col("topic")).when((F.col("topic") == MIXED_TOPIC) & poisson, "Poisson")


def within_syllabus(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and (reason, n) of those that go."""
    reasoned = rows.withColumn("reason", drop_reason())
    return reasoned.where("reason is null").drop("reason"), reasoned.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def collapse_provenance(rows: DataFrame) -> DataFrame:
    """The first row (by ``ord``) of each full provenance. Rows without one, and exempt rows, all stay and block none."""
    tag = tx.provenance_identity(F.col("school"), F.col("year"), F.col("paper"), F.col("question_no"))
    tagged = rows.withColumn("_tag", F.when(~F.coalesce(F.col("id").isin(*MISTYPED_PROVENANCE), F.lit(False)), tag))
    # Rows without a tag would meet in one window partition; they take no part in it.
    order = Window.partitionBy("_tag").orderBy("ord")
    first = tagged.where("_tag is not null").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return first.unionByName(tagged.where("_tag is null")).drop("_tag")


def collapse_text(rows: DataFrame, least: int = MIN_TEXT_MATCH) -> DataFrame:
    """The first row (by ``ord``) of each comparable text of ``least`` characters or more; shorter ones all stay."""
    keyed = rows.withColumn("_key", tx.comparable_text("text"))
    keyed = keyed.withColumn("_key", F.when(F.length("_key") >= least, F.sha2("_key", 256)))
    order = Window.partitionBy("_key").orderBy("ord")
    first = keyed.where("_key is not null").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return first.unionByName(keyed.where("_key is null")).drop("_key")


def collapse_duplicates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The deduplicated rows, and one row of counts: by_provenance, by_text."""
    first = collapse_provenance(rows)
    second = collapse_text(first)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    counts = count(rows, "a").join(count(first, "b")).join(count(second, "c"))
    return second, counts.select((F.col("a") - F.col("b")).alias("by_provenance"), (F.col("b") - F.col("c")).alias("by_text"))


def resolve_labels(rows: DataFrame, name: str, out: str = "chapter") -> DataFrame:
    """``rows`` with the label that a folder name stands for: slug, alias, hyphenated form, display name; else null."""
    keys = dims.spellings(rows.sparkSession)
    key = F.lower(F.trim(F.col(name)))
    joined = rows.withColumns({"_exact": key, "_hyphenated": F.replace(F.replace(key, F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-"))})
    for n, form in ((1, "exact"), (2, "exact"), (3, "hyphenated"), (4, "exact")):
        own = keys.where((F.col("priority") == n) & (F.col("form") == form)).select(F.col("key").alias(f"_key{n}"), F.col("slug").alias(f"_slug{n}"))
        joined = joined.join(F.broadcast(own), F.col(f"_{form}") == F.col(f"_key{n}"), "left")  # at most 21 rows
    return joined.select(*[joined[c] for c in rows.columns], F.coalesce(*[F.col(f"_slug{n}") for n in (1, 2, 3, 4)]).alias(out))


def with_source_file(rows: DataFrame) -> DataFrame:
    """``rows`` with the file that a row without provenance is grouped by."""
    return rows.withColumn("source_file", tx.grouping_hint(F.col("source"), F.col("id")))


def labelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a label and rows without (null or empty)."""
    has = F.coalesce("chapter", F.lit("")) != ""
    return rows.where(has), rows.where(~has)


def bad_ids(rows: DataFrame) -> DataFrame:
    """Ids that are missing, empty or repeated, with their count."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null or id = ''")


def require_unique_ids(rows: DataFrame) -> None:
    """Raise if any id is missing or repeated."""
    found = [str(r.id) for r in bad_ids(rows).orderBy("id").limit(5).collect()]
    if found:
        raise CorpusError(f"every row needs an id of its own; not so: {found}")


def unknown_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the rows that the dictionary (slug) does not have."""
    return rows.select("chapter").distinct().join(labels.select(F.col("slug").alias("chapter")), "chapter", "left_anti")


def counts_with_zeros(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """class_id, slug, n of every label, those without rows too."""
    counts = rows.groupBy(F.col("chapter").alias("slug")).agg(F.count("*").alias("n"))
    return labels.join(counts, "slug", "left").select("class_id", "slug", F.coalesce("n", F.lit(0)).alias("n"))


def thinnest(counts: DataFrame) -> DataFrame:
    """The label of the fewest rows; ties go to the lower class id."""
    return counts.agg(F.min_by("slug", F.struct("n", "class_id")).alias("slug"), F.min("n").alias("n"))


def extremes(rows: DataFrame) -> DataFrame:
    """The ids of the shortest and longest text; ties go to the first row."""
    n = F.length(F.coalesce("text", F.lit("")))
    return rows.agg(F.min_by("id", F.struct(n, F.col("ord"))).alias("shortest"), F.max_by("id", F.struct(n, -F.col("ord"))).alias("longest"))


def take_until(pages: DataFrame, by: str, page: str, stop: Column) -> DataFrame:
    """The pages of each ``by`` before the first that stops: an ordered prefix."""
    cut = F.min(F.when(stop, F.col(page))).over(Window.partitionBy(by))
    return pages.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col(page) < F.col("_cut"))).drop("_cut")


def bag_counts(rows: DataFrame, bag: str) -> DataFrame:
    """How often each token stands in an array column."""
    return rows.select(F.explode(bag).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


#: Marks of solutions, which no question row may hold.
SOLUTION_MARKS = ("\\Sol", "\\solend")


def row_faults(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """id, fault of every row that an extractor must not give out: no id, a repeated id, an unknown label, no text, solution marks."""
    named = labels.select(F.col("slug").alias("_slug"))
    judged = rows.join(named, rows.chapter == F.col("_slug"), "left")
    raw = F.coalesce(F.col("raw_text") if "raw_text" in rows.columns else F.col("text"), F.lit(""))
    marked = F.lit(False)
    for mark in SOLUTION_MARKS:
        marked = marked | raw.contains(mark)
    faults = F.array_compact(F.array(
        F.when(F.coalesce("id", F.lit("")) == "", "no id"),
        F.when(F.coalesce("chapter", F.lit("")).isin("") | F.col("_slug").isNotNull(), None).otherwise("unknown label"),
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text"),
        F.when(marked, "solution marks"),
    ))
    single = judged.select("id", F.explode(faults).alias("fault"))
    repeated = bad_ids(rows).where("n > 1 and id <> ''").select("id", F.lit("repeated id").alias("fault"))
    return single.unionByName(repeated)


def require_sound(rows: DataFrame, labels: DataFrame) -> None:
    """Raise if any row has a fault."""
    found = [f"{r.id}: {r.fault}" for r in row_faults(rows, labels).orderBy("id", "fault").limit(5).collect()]
    if found:
        raise CorpusError(f"rows that must not be written: {found}")


def rows_by_source(rows: DataFrame) -> DataFrame:
    """source, rows, labels, unlabelled of an extraction."""
    has = F.coalesce("chapter", F.lit("")) != ""
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct(F.when(has, F.col("chapter"))).alias("labels"), F.count_if(~has).alias("unlabelled"))
