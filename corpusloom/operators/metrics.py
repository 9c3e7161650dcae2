"""Measures of predictions: accuracy, confusions, per-label scores, calibration, paired outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

#: The thresholds of a sweep are steps of 0.05; the accuracy that a cutoff must reach; calibration bins.
STEPS, TARGET, BINS = 20, 0.95, 10
RANGES = 256


def accuracy(predictions: DataFrame) -> DataFrame:
    """n, correct, accuracy."""
    right = F.coalesce((F.col("y_true") == F.col("predicted")).cast("int"), F.lit(0))
    return predictions.agg(F.count("*").alias("n"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.avg(right.cast("double")).alias("accuracy"))


def confusions(predictions: DataFrame) -> DataFrame:
    """y_true, predicted, n, first_ord of wrong pairs; worst first is n descending, then first_ord."""
    wrong = predictions.where(F.col("y_true") != F.col("predicted"))
    return wrong.groupBy("y_true", "predicted").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def worst_confusions(predictions: DataFrame, k: int = 8, least: int = 1) -> DataFrame:
    """The ``k`` most frequent confusions of at least ``least`` rows, worst first; and how many pairs occur once."""
    found = confusions(predictions)
    top = found.where(F.col("n") >= least).orderBy(F.col("n").desc(), "first_ord").limit(k)
    return top.join(F.broadcast(found.agg(F.count_if(F.col("n") == 1).alias("singles"))))


def confusion_matrix(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """y_true, predicted, n of every pair of labels."""
    pairs = labels.select(F.col("slug").alias("y_true")).join(labels.select(F.col("slug").alias("predicted")))
    counts = predictions.groupBy("y_true", "predicted").agg(F.count("*").alias("n"))
    return pairs.join(counts, ["y_true", "predicted"], "left").select("y_true", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_label(predictions: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of every label that is true or predicted; 0 where a share is undefined."""
    sides = predictions.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col("y_true") == F.col("predicted")).alias("ok")).select("s.*", "ok")
    sums = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("guessed"), F.sum(F.when(F.col("ok"), F.col("t")).otherwise(0)).alias("hit"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("hit"), F.col("guessed")), share(F.col("hit"), F.col("support"))
    return sums.select("label", "support", precision.alias("precision"), recall.alias("recall"), share(2 * F.col("hit"), F.col("support") + F.col("guessed")).alias("f1"))


def macro_f1(predictions: DataFrame) -> DataFrame:
    """The mean F1 over all labels that are true or predicted."""
    return per_label(predictions).agg(F.avg("f1").alias("macro_f1"))


def spread(values: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, stdev, low, high; one value has a deviation of 0."""
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.min(value).alias("low"), F.max(value).alias("high"))


def paired_outcomes(first: DataFrame, second: DataFrame) -> DataFrame:
    """both_right, only_a, only_b, both_wrong of two prediction sets over the same rows (by ``ord``).

    Rows that one side lacks are an error.
    """
    a = first.select("ord", "y_true", F.col("predicted").alias("a"))
    b = second.select(F.col("ord").alias("_ord"), F.col("predicted").alias("b"))
    joined = a.join(b, a.ord == b["_ord"], "full")
    missing = F.when(F.col("ord").isNull() | F.col("_ord").isNull(), F.raise_error(F.lit("both sides of a comparison need predictions of the same rows")))
    right_a, right_b = F.coalesce(F.col("a") == F.col("y_true"), F.lit(False)), F.coalesce(F.col("b") == F.col("y_true"), F.lit(False))
    judged = joined.select(F.coalesce(missing.cast("boolean"), right_a).alias("ra"), right_b.alias("rb"))
    return judged.agg(F.count_if(F.col("ra") & F.col("rb")).alias("both_right"), F.count_if(F.col("ra") & ~F.col("rb")).alias("only_a"), F.count_if(~F.col("ra") & F.col("rb")).alias("only_b"), F.count_if(~F.col("ra") & ~F.col("rb")).alias("both_wrong"))


def sweep(predictions: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """threshold, answered, total, coverage, selective_accuracy, full_accuracy of each threshold.

    Every row adds to one pass of conditional counts; predictions are not multiplied by thresholds.
    """
    thresholds = [i * 5 / 100.0 for i in range(STEPS + 1)] if thresholds is None else thresholds
    kept = [F.coalesce(F.col("confidence") >= t, F.lit(False)) for t in thresholds]
    right = F.coalesce(F.col("y_true") == F.col("predicted"), F.lit(False))
    sums = predictions.agg(F.count("*").alias("total"), *[F.count_if(k).alias(f"a{i}") for i, k in enumerate(kept)], *[F.count_if(k & right).alias(f"c{i}") for i, k in enumerate(kept)])
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("answered"), F.col(f"c{i}").alias("correct")) for i, t in enumerate(thresholds)])
    each = sums.select("total", F.explode(points).alias("p")).select("p.*", "total")
    return each.select("threshold", "answered", "total", F.when(F.col("total") > 0, F.col("answered") / F.col("total")).otherwise(0.0).alias("coverage"), F.when(F.col("answered") > 0, F.col("correct") / F.col("answered")).alias("selective_accuracy"), F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("full_accuracy"))


def selective_interval(points: DataFrame) -> DataFrame:
    """``points`` of a sweep with the Wilson interval of the accuracy of what is answered; nulls where nothing is."""
    some = points.withColumn("_n", F.greatest(F.col("answered"), F.lit(1)))
    low, high = stats.wilson_interval(F.coalesce(F.col("selective_accuracy"), F.lit(0.0)) * F.col("answered"), F.col("_n"))
    return some.withColumns({"low": F.when(F.col("answered") > 0, low), "high": F.when(F.col("answered") > 0, high)}).drop("_n")


def select_cutoff(points: DataFrame, target: float = TARGET) -> DataFrame:
    """The lowest threshold whose answered rows reach the target; 0.0 if none does."""
    return points.agg(F.coalesce(F.min(F.when(F.col("selective_accuracy") >= target, F.col("threshold"))), F.lit(0.0)).alias("cutoff"))


def reliability(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, lower, upper, n, mean_confidence, accuracy; empty bins stay, with nulls. The last bin includes its upper bound."""
    spark = predictions.sparkSession
    bounds = F.broadcast(spark.range(bins).select(F.col("id").alias("bin"), (F.col("id") / float(bins)).alias("lower"), ((F.col("id") + 1) / float(bins)).alias("upper")))
    # The bin of a confidence by comparison with the exact bounds, not by arithmetic on it.
    index = sum((F.col("confidence") >= i / bins).cast("int") for i in range(1, bins))
    own = predictions.where((F.col("confidence") >= 0) & (F.col("confidence") <= 1)).withColumn("bin", index.cast("long"))
    sums = own.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("y_true") == F.col("predicted")).cast("double")).alias("accuracy"))
    return sums.join(bounds, "bin", "right").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def calibration_gap(bins: DataFrame) -> DataFrame:
    """mean_gap and signed_gap between confidence and accuracy, weighted by rows."""
    gap = F.col("mean_confidence") - F.col("accuracy")
    full = bins.where("n > 0")
    return full.agg((F.sum(F.col("n") * F.abs(gap)) / F.sum("n")).alias("mean_gap"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("signed_gap"))


def top_k(ranked: DataFrame, k: int, *by: str, score: str = "score", tie: str = "class_id") -> DataFrame:
    """The k best of each ``by``: score descending, then the higher tie value."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie).desc())
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def truth_score(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """found, exact, wanted, spurious of cut questions against truth, by (paper_id, number, start_page, pages)."""
    last = predicted.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id", "number").orderBy(F.col("ord").desc()))).where("_r = 1")
    p = last.select(F.col("paper_id").alias("pp"), F.col("number").alias("pn"), F.col("start_page").alias("ps"), F.col("pages").alias("pg"))
    joined = truth.join(p, (truth.paper_id == p.pp) & (truth.number == p.pn), "left")
    found = F.coalesce(F.col("ps") == F.col("start_page"), F.lit(False))
    hits = joined.agg(F.count("*").alias("wanted"), F.count_if(found).alias("found"), F.count_if(found & (F.col("pg") == F.col("pages"))).alias("exact"))
    own = truth.select("paper_id", "number", "start_page")
    spurious = predicted.join(own, ["paper_id", "number", "start_page"], "left_anti").agg(F.count("*").alias("spurious"))
    return hits.join(spurious)


def percentiles(values: DataFrame, value: str, shares: list[int]) -> DataFrame:
    """share, value: nearest rank, its index rounded half to even.

    Distinct values are counted, and ranked within ranges between approximate quantiles; one sum for each
    range gives what lies below it, so that no task has to rank all of them.
    """
    counts = values.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cuts = sorted(set(counts.agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    placed = counts.withColumn("range", at)
    below = placed.groupBy("range").agg(F.sum("n").alias("sum")).select(F.col("range").alias("r"), F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))  # RANGES rows at most
    within = F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    upto = placed.withColumn("own", within).join(F.broadcast(below), F.col("range") == F.col("r")).select("value", "n", (F.col("own") + F.col("below")).alias("upto"))
    total = values.agg(F.count("*").alias("total"))
    wanted = total.select("total", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    place = F.greatest(F.least(F.bround(F.col("share") / 100.0 * F.col("total")), F.col("total")) - 1, F.lit(0))
    asked = F.broadcast(wanted.withColumn("at", place))  # one row for each share
    return upto.join(asked, (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select("share", "value")


def truncation_cost(values: DataFrame, value: str, limits: list[int]) -> DataFrame:
    """limit, cut, share_cut, lost, share_lost."""
    over = [F.greatest(F.col(value) - n, F.lit(0)) for n in limits]
    sums = values.agg(F.count("*").alias("rows"), F.sum(value).alias("tokens"), *[F.count_if(x > 0).alias(f"n{i}") for i, x in enumerate(over)], *[F.sum(x).alias(f"l{i}") for i, x in enumerate(over)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("limit"), F.col(f"n{i}").alias("cut"), F.col(f"l{i}").alias("lost")) for i, n in enumerate(limits)]))
    return sums.select("rows", "tokens", each.alias("x")).select("x.limit", "x.cut", (F.col("x.cut") / F.col("rows")).alias("share_cut"), "x.lost", (F.col("x.lost") / F.col("tokens")).alias("share_lost"))
