"""Leakage groups: counting, targets, leakage checks, and the impact of another key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The splits and their shares, the floor of test rows per label.
SPLITS = ("train", "val", "test")
FRACTIONS = {"train": 0.70, "val": 0.15, "test": 0.15}
MIN_TEST_ROWS = 5


def with_group_key(rows: DataFrame, name: str = "key") -> DataFrame:
    """``rows`` with their leakage group."""
    return rows.withColumn(name, tx.leakage_group_key(F.col("school"), F.col("year"), F.col("paper"), F.col("source_file"), F.col("id")))


def group_counts(keyed: DataFrame) -> DataFrame:
    """key, n, first_ord: the groups, in the order in which they were first seen."""
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def group_label_matrix(keyed: DataFrame) -> DataFrame:
    """key, chapter, n."""
    return keyed.groupBy("key", "chapter").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def targets(rows: DataFrame, min_test_rows: int = MIN_TEST_ROWS) -> DataFrame:
    """chapter, total, train, val, test: how many rows each split should have."""
    total = rows.groupBy("chapter").agg(F.count("*").alias("total"))
    test = F.greatest(F.lit(FRACTIONS["test"]) * F.col("total"), F.least(F.lit(min_test_rows), F.col("total")).cast("double"))
    ratio = FRACTIONS["train"] / (FRACTIONS["train"] + FRACTIONS["val"])
    return total.withColumn("test", test).select("chapter", "total", ((F.col("total") - F.col("test")) * ratio).alias("train"), ((F.col("total") - F.col("test")) * (1 - ratio)).alias("val"), "test")


def pure_blocks(keyed: DataFrame, min_test_rows: int = MIN_TEST_ROWS) -> DataFrame:
    """chapter, key, block, scattered, pinned: the largest group of one label only, and whether it must be tested on.

    Ties of size go to the group seen first.
    """
    per = group_label_matrix(keyed)
    total = per.groupBy("chapter").agg(F.sum("n").alias("total"))
    pure = per.groupBy("key").agg(F.count("*").alias("kinds"), F.first("chapter").alias("chapter"), F.first("n").alias("n"), F.min("first_ord").alias("first_ord")).where("kinds = 1")
    largest = pure.groupBy("chapter").agg(F.max_by(F.struct("key", "n"), F.struct(F.col("n"), -F.col("first_ord"))).alias("top"))
    found = largest.join(total, "chapter").select("chapter", "top.key", F.col("top.n").alias("block"), (F.col("total") - F.col("top.n")).alias("scattered"))
    return found.withColumn("pinned", (F.col("block") >= min_test_rows) & (F.col("scattered") < min_test_rows + 2))


def straddling(keyed: DataFrame) -> DataFrame:
    """key, splits, n, test_rows: groups whose rows lie in more than one split."""
    found = keyed.groupBy("key").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test_rows"))
    return found.where("splits > 1")


def split_summary(keyed: DataFrame) -> DataFrame:
    """Rows and groups by split, by label and split, and altogether (nulls stand for all)."""
    return keyed.sparkSession.sql(
        "select chapter, split, count(*) as n, count(distinct key) as groups, count_if(key.kind = 'row') as ungroupable from {rows} group by grouping sets ((split), (chapter, split), ())", rows=keyed
    )


def key_impact(keyed: DataFrame, old: str = "old_key", new: str = "new_key") -> DataFrame:
    """new key, merged, n: groups of the new key that join several old ones, and their rows."""
    found = keyed.groupBy(new).agg(F.count_distinct(old).alias("merged"), F.count("*").alias("n"))
    return found.where("merged > 1")


def largest_merged(impact: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` groups of :func:`key_impact` that join most rows, largest first."""
    return impact.orderBy(F.col("n").desc(), F.col("merged").desc()).limit(k)


def fold_schools(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with the schools that ``aliases`` (alias, school) names folded together."""
    names = aliases.select(F.col("alias").alias("_alias"), F.col("school").alias("_school"))
    joined = rows.join(names, rows.school == names["_alias"], "left")
    return joined.withColumn("school", F.coalesce("_school", "school")).drop("_alias", "_school")


def lost_and_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """side, id: ids that are in one of two frames only, as often as they are."""
    lost = before.select("id").exceptAll(after.select("id")).select(F.lit("lost").alias("side"), "id")
    return lost.unionByName(after.select("id").exceptAll(before.select("id")).select(F.lit("added").alias("side"), "id"))


def short_labels(keyed: DataFrame, labels: DataFrame, split: str = "test", floor: int = MIN_TEST_ROWS) -> DataFrame:
    """slug, n of labels with fewer rows in a split than the floor."""
    own = keyed.where(F.col("split") == split).groupBy(F.col("chapter").alias("slug")).agg(F.count("*").alias("n"))
    return labels.join(own, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < floor)


def class_weights(rows: DataFrame) -> DataFrame:
    """chapter, n, weight: n_all / (labels * n)."""
    per = rows.groupBy("chapter").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    return per.withColumn("weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))


def key_name(key: str = "key") -> Column:
    """A leakage group as text, the same for equal groups."""
    return F.concat_ws("|", f"{key}.kind", F.coalesce(f"{key}.school", F.lit("")), F.coalesce(F.col(f"{key}.year").cast("string"), F.lit("")), F.coalesce(f"{key}.paper", F.lit("")), F.coalesce(f"{key}.ref", F.lit("")))


BUCKETS = 1 << 12


def sums_before(rows: DataFrame, by: str, digest: str, *ties: str, weight: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``weight`` over the rows of the same ``by`` whose hex ``digest`` (then ``ties``) comes earlier.

    Rows are sorted only within ``BUCKETS`` ranges of the digest, and a table of one sum for each ``by`` and range
    gives what comes before a range, so that no ``by`` has to be sorted in one task.
    """
    placed = rows.withColumn("_bucket", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))
    within = Window.partitionBy(by, "_bucket").orderBy(digest, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(by, "_bucket").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    own = placed.withColumn("_own", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return own.join(ranges, own[by].eqNullSafe(ranges["_by"]) & (own["_bucket"] == ranges["_b"])).withColumn("before", F.col("_own") + F.col("_earlier")).drop("_own", "_earlier", "_bucket", "_by", "_b")


def subsample(keyed: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Whole groups of every split, in a seeded hash order, until the fraction is met; test stays whole.

    The last group taken may pass the target.
    """
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    sizes = keyed.groupBy("split", "key").agg(F.count("*").alias("n")).withColumn("_name", key_name())
    sizes = sizes.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("split"), F.lit(":"), F.col("_name"))))
    totals = keyed.groupBy(F.col("split").alias("_s")).agg(F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.count("*"))).alias("target"))
    sizes = sums_before(sizes, "split", "_h", "_name", weight="n")
    sizes = sizes.join(F.broadcast(totals), sizes.split.eqNullSafe(totals["_s"]))  # one row for each split
    kept = sizes.withColumn("_taken", (F.col("split") == "test") | (F.col("before") < F.col("target"))).where("_taken").select(F.col("split").alias("_split"), F.col("key").alias("_key"))
    return keyed.join(kept, keyed.split.eqNullSafe(kept["_split"]) & keyed.key.eqNullSafe(kept["_key"]), "left_semi")
