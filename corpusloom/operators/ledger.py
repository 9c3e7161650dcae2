"""The run ledger: latest records, comparable runs, summaries, learning-curve increments, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

#: Two fractions are equal within this; flat steps; significance.
SAME_FRACTION, FLAT, SIGNIFICANT = 1e-9, 0.005, 0.05


def latest(runs: DataFrame, *key: str, recorded: str = "recorded") -> DataFrame:
    """The last record of each key; ties go to the greatest record. An upsert seen from the reader's side."""
    order = Window.partitionBy(*key).orderBy(F.col(recorded).desc(), *[F.col(c).desc() for c in runs.columns if c not in key and not c.startswith("_")])
    return runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def comparable(runs: DataFrame, test_hash: str, conditions: dict | None = None, fraction: float | None = None) -> DataFrame:
    """Runs of the same test split and, if given, the same conditions and fraction."""
    found = runs.where(F.col("test_hash") == test_hash)
    if conditions is not None:
        found = found.where(F.col("conditions.class_weights").eqNullSafe(F.lit(conditions["class_weights"])) & F.col("conditions.max_tokens").eqNullSafe(F.lit(conditions["max_tokens"])))
    return found if fraction is None else found.where(F.abs(F.col("fraction") - fraction) < SAME_FRACTION)


def summary(runs: DataFrame, *by: str) -> DataFrame:
    """Of each ``by``: runs, mean and spread of accuracy, and the Wilson interval of the mean number right (of ``correct`` and ``test_rows``)."""
    accuracy = F.col("correct") / F.col("test_rows")
    sums = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(accuracy).alias("mean"), F.coalesce(F.stddev_samp(accuracy), F.lit(0.0)).alias("stdev"), F.min(accuracy).alias("low"), F.max(accuracy).alias("high"), F.avg("correct").alias("mean_correct"), F.max("test_rows").alias("test_rows"))
    low, high = stats.wilson_interval(F.col("mean_correct"), F.col("test_rows"))
    return sums.withColumns({"wilson_low": low, "wilson_high": high})


def increments(points: DataFrame, value: str = "mean", at: str = "fraction", *by: str) -> DataFrame:
    """``points`` with the step from the point before."""
    return points.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(at)))


def missing(wanted: DataFrame, runs: DataFrame, *key: str) -> DataFrame:
    """The wanted runs that the ledger does not have."""
    return wanted.join(runs.select(*key), list(key), "left_anti")


def rows_trained_on(pool_rows: Column | int) -> Column:
    """How many rows a run was trained on; a record without the number had the whole pool."""
    return F.coalesce(F.col("train_rows"), pool_rows if isinstance(pool_rows, Column) else F.lit(pool_rows))


def default_run(runs: DataFrame, *by: str, seed: int = 42) -> DataFrame:
    """Of each ``by``: the run of the default seed, else that of the lowest."""
    order = F.struct(F.col("seed") != seed, F.col("seed"))
    own = F.struct(*[c for c in runs.columns if c not in by])
    return runs.groupBy(*by).agg(F.min_by(own, order).alias("run")).select(*by, "run.*")


def answers(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """approach, fraction, seed, ord, y_true, predicted of every recorded prediction: ``runs`` has ``predicted`` arrays, by place as ``truth`` (ord from 0, y_true)."""
    each = runs.select("approach", "fraction", "seed", F.posexplode("predicted").alias("ord", "predicted"))
    return each.join(truth.select(F.col("ord").cast("int").alias("ord"), "y_true"), "ord").select("approach", "fraction", "seed", "ord", "y_true", "predicted")


def paired(first: DataFrame, second: DataFrame, *by: str) -> DataFrame:
    """Of each ``by``: how two sets of predictions (by, ord, y_true, predicted) over the same rows agree, their difference with its interval, and the exact p.

    Groups that one side lacks are left out, and so are its predictions of other rows.
    """
    other = second.select(*by, "ord", F.col("predicted").alias("_b"))
    a, b = F.col("predicted") == F.col("y_true"), F.col("_b") == F.col("y_true")
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    counted = first.join(other, [*by, "ord"]).groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"), F.count("*").alias("n"))
    low, high = stats.paired_difference_interval(F.col("only_b"), F.col("only_a"), F.col("n"))
    return stats.mcnemar(counted.withColumns({"difference": (F.col("only_b") - F.col("only_a")) / F.col("n"), "low": low, "high": high}))


def last_step(predictions: DataFrame) -> DataFrame:
    """The last two fractions of each approach, paired seed by seed: :func:`paired` by approach and seed, with ``earlier`` and ``later``.

    Only seeds that both fractions have are compared; an approach of one fraction has no row.
    """
    points = predictions.select("approach", "fraction").distinct()
    ranked = points.withColumn("_r", F.row_number().over(Window.partitionBy("approach").orderBy(F.col("fraction").desc()))).where("_r <= 2")
    ends = ranked.groupBy("approach").agg(F.max(F.when(F.col("_r") == 2, F.col("fraction"))).alias("earlier"), F.max(F.when(F.col("_r") == 1, F.col("fraction"))).alias("later")).where("earlier is not null")
    own = predictions.join(ends, "approach")
    side = lambda which: own.where(F.col("fraction") == F.col(which))
    return paired(side("earlier"), side("later"), "approach", "seed").join(ends, "approach")


def seed_coverage(runs: DataFrame) -> DataFrame:
    """approach, fraction, seeds of every point of a curve."""
    return runs.groupBy("approach", "fraction").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))


def verdict(pairs: list[tuple[float, float]]) -> str:
    """What (difference, p) of each seed say of two approaches.

    ``distinguishable`` if every test is significant and the same side leads each time,
    ``indistinguishable`` if none is, else ``mixed``.
    """
    leads = [d > 0 for d, p in pairs if p < SIGNIFICANT]
    if not leads:
        return "indistinguishable"
    return "distinguishable" if len(leads) == len(pairs) and len(set(leads)) == 1 else "mixed"


def shape(means: list[float], seeds: list[set[int]], pairs: list[tuple[float, float]]) -> str:
    """What a learning curve does at its last point, from its means, the seeds of each point, and (difference, p) of each seed's last step.

    ``incomplete`` without two points of one common seed set; ``flat`` if the whole gain is
    negligible; ``flattened`` if no test of the last step is significant; ``climbing`` or
    ``falling`` if all are, one way; else ``mixed``.
    """
    if len(means) < 2 or any(s != seeds[0] for s in seeds) or not pairs:
        return "incomplete"
    if abs(means[-1] - means[0]) < FLAT:
        return "flat"
    rises = [d > 0 for d, p in pairs if p < SIGNIFICANT]
    if not rises:
        return "flattened"
    if len(rises) == len(pairs) and len(set(rises)) == 1:
        return "climbing" if rises[0] else "falling"
    return "mixed"


def curves_differ(one: dict, two: dict) -> str:
    """How two curves (name, means and seeds by fraction, in order) compare over the range that was measured.

    ``incomplete`` unless every point of both has the same seeds; ``alike`` if the gains differ by less than the
    flat step; else the name of the curve that gains more.
    """
    seeds = [frozenset(s) for curve in (one, two) for s in curve["seeds"]]
    if not one["means"] or not two["means"] or len(set(seeds)) != 1:
        return "incomplete"
    gain = [curve["means"][-1] - curve["means"][0] for curve in (one, two)]
    if abs(gain[1] - gain[0]) < FLAT:
        return "alike"
    return two["name"] if gain[1] > gain[0] else one["name"]
