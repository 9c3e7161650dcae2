"""Intervals and tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % point of the standard normal distribution.
Z_95 = 1.959964


def wilson_interval(correct: Column, total: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval, within 0 and 1. ``correct`` may be a mean; impossible counts are errors."""
    bad = F.when(total.isNull() | (total <= 0), F.raise_error(F.lit("an interval needs at least one trial"))).when((correct < 0) | (correct > total), F.raise_error(F.lit("correct must lie between 0 and total")))
    n = F.coalesce(bad.cast("double"), total.cast("double"))
    p, zz = correct / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def paired_difference_interval(only_a: Column, only_b: Column, total: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wald interval of a paired difference of proportions."""
    n = total.cast("double")
    d = (only_a - only_b) / n
    half = z * F.sqrt(F.greatest(F.lit(0.0), ((only_a + only_b) - (only_a - only_b) * (only_a - only_b) / n) / (n * n)))
    return d - half, d + half


def intervals_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two closed intervals meet."""
    return (low_a <= high_b) & (low_b <= high_a)


def mcnemar(pairs: DataFrame, only_a: str = "only_a", only_b: str = "only_b", name: str = "p") -> DataFrame:
    """``pairs`` with the exact two-sided McNemar p-value of their discordant counts.

    Binomial terms come from logarithms of factorials, a running sum over as many numbers as the
    largest discordant total; they are joined by (n, k), so no row holds more than one term.
    """
    spark = pairs.sparkSession
    keyed = pairs.withColumn("_n", F.col(only_a) + F.col(only_b)).withColumn("_k", F.least(only_a, only_b))
    asked = keyed.select("_n", "_k").distinct()
    largest = asked.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    steps = spark.range(0, largest + 1).select(F.col("id").alias("i"), F.when(F.col("id") > 0, F.log(F.col("id").cast("double"))).otherwise(0.0).alias("ln"))
    logs = steps.select("i", F.sum("ln").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("lf"))
    terms = asked.select("_n", "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long"))).alias("j"))
    for column, alias in ((F.col("_n"), "lf_n"), (F.col("j"), "lf_j"), (F.col("_n") - F.col("j"), "lf_r")):
        table = logs.select(F.col("i").alias(f"i_{alias}"), F.col("lf").alias(alias))
        terms = terms.join(table, column == F.col(f"i_{alias}"))
    tails = terms.groupBy("_n", "_k").agg(F.sum(F.exp(F.col("lf_n") - F.col("lf_j") - F.col("lf_r") - F.col("_n") * F.log(F.lit(2.0)))).alias("tail"))
    p = F.when(F.col("_n") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("tail")))
    return keyed.join(tails, ["_n", "_k"]).withColumn(name, p).drop("_n", "_k", "tail")
