"""Experiments over a split corpus: timed runs, fresh splits, learning curves, abstention."""

from __future__ import annotations

import platform
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators import groups, ledger, metrics, service
from ..operators import split as splitting
from . import model

#: The fractions of a learning curve, seeds of runs and of fresh splits.
FRACTIONS, SEEDS, RESPLIT_SEEDS = (0.25, 0.5, 0.75, 1.0), (42, 43, 44), tuple(range(1, 11))


class RefitError(RuntimeError):
    """A refit that does not give the ledger's predictions."""


def hardware(spark: SparkSession) -> str:
    """What a run was timed on."""
    return f"Spark {spark.version} on {spark.sparkContext.defaultParallelism} cores, {platform.machine()}, {spark.sparkContext.master}"


def parts(split: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, val, test with normalised texts."""
    rows = split.withColumn("text", tx.normalise_question("text"))
    return tuple(rows.where(F.col("split") == s) for s in groups.SPLITS)


def read_split(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """ord, text, chapter, split of the named parts of a written split; only their folders are read."""
    rows = spark.read.option("basePath", path).schema(f"{schemas.CORPUS}, ord long, split string").json([f"{path}/split={n}" for n in names or groups.SPLITS])
    return rows.select("ord", tx.normalise_question("text").alias("text"), "chapter", "split")


def pool_rows(split: DataFrame) -> int:
    """Rows of train and validation together."""
    return split.where("split <> 'test'").count()


def compare_runs(records: list[dict], y_true: list[str], spark: SparkSession) -> DataFrame:
    """approach, runs, mean, best, worst, gap of accuracy, and mean macro-F1, of ledger records over one test split."""
    rows = [(r["approach"], r["seed"], i, t, p) for r in records for i, (t, p) in enumerate(zip(y_true, r["predicted"], strict=True))]
    each = spark.createDataFrame(rows, "approach string, seed int, ord int, y_true string, predicted string")
    runs_ = each.groupBy("approach", "seed").agg(F.avg((F.col("y_true") == F.col("predicted")).cast("double")).alias("accuracy"))
    f1 = [(r["approach"], r["seed"], float(metrics.macro_f1(each.where((F.col("approach") == r["approach"]) & (F.col("seed") == r["seed"]))).first().macro_f1)) for r in records]
    joined = runs_.join(spark.createDataFrame(f1, "approach string, seed int, macro_f1 double"), ["approach", "seed"])
    return joined.groupBy("approach").agg(F.count("*").alias("runs"), F.avg("accuracy").alias("mean"), F.max("accuracy").alias("best"), F.min("accuracy").alias("worst"), (F.max("accuracy") - F.min("accuracy")).alias("gap"), F.avg("macro_f1").alias("macro_f1"))


def fit_train_only(split: DataFrame, candidates: tuple[float, ...] = model.CANDIDATES) -> tuple[model.ChapterModel, DataFrame]:
    """The model of train alone, with the C that validation prefers, and its predictions of validation rows."""
    train, val, _ = parts(split)
    c, _ = model.choose(train, val, candidates)
    fitted = model.fit(train, c)
    return fitted, predictions(fitted, val)


def predictions(fitted: model.ChapterModel, rows: DataFrame) -> DataFrame:
    """ord, y_true, predicted, confidence."""
    return fitted.transform(rows).select("ord", F.col("chapter").alias("y_true"), "predicted", "confidence")


def test_hash(split: DataFrame) -> str:
    """The first 16 digits of the hash of the test rows."""
    return service.frame_sha256(split.where("split = 'test'"), "id", "chapter", "text")[:16]


def run_tfidf(split: DataFrame, seed: int = 42, fraction: float = 1.0, candidates: tuple[float, ...] = model.CANDIDATES) -> dict:
    """The record of one run: subsample, tune on validation, refit on both, score the test rows."""
    whole = test_hash(split)
    pool = split if fraction == 1.0 else groups.subsample(split, fraction, seed)
    if fraction != 1.0:
        splitting.check_subsample(split, pool)
    train, val, test = parts(pool)
    began = time.perf_counter()
    fitted, c = model.tune_and_refit(train, val, candidates)
    seconds = time.perf_counter() - began
    found = predictions(fitted, test).orderBy("ord").select("predicted").collect()  # the sealed test split of one corpus
    return {
        "approach": "tfidf", "seed": seed, "predicted": [r.predicted for r in found], "test_hash": whole, "test_rows": len(found), "train_seconds": seconds,
        "parameters": fitted.parameters(), "hardware": hardware(split.sparkSession), "recorded": datetime.now(UTC).isoformat(), "method": f"tfidf, logistic regression, C={c}",
        "features": len(fitted.vocabulary.vocabulary), "conditions": {"class_weights": True, "max_tokens": 512}, "fraction": fraction, "train_rows": pool.where("split <> 'test'").count(),
    }


def resplit(rows: DataFrame, seed: int, labels: DataFrame | None = None, candidates: tuple[float, ...] = model.CANDIDATES) -> tuple[int, int]:
    """(right, test rows) of the classifier on a fresh, checked split."""
    fresh = splitting.split_rows(rows, seed, labels=labels)
    splitting.check(rows, fresh, labels)
    train, val, test = parts(fresh)
    fitted, _ = model.tune_and_refit(train, val, candidates)
    found = metrics.accuracy(predictions(fitted, test)).first()
    return int(found.correct), int(found.n)


def wanted_runs(spark, approaches: list[str], seeds: tuple[int, ...] = SEEDS, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """approach, fraction, seed of every point of a curve; with :func:`ledger.missing`, what is still to be run."""
    return spark.createDataFrame([(a, f, s) for a in approaches for f in fractions for s in seeds], "approach string, fraction double, seed int")


def learning_curve(split: DataFrame, runs: DataFrame, record, seeds: tuple[int, ...] = SEEDS, fractions: tuple[float, ...] = FRACTIONS) -> int:
    """Run and ``record`` the points that the ledger (approach, fraction, seed) lacks; how many they were."""
    todo = ledger.missing(wanted_runs(split.sparkSession, ["tfidf"], seeds, fractions), runs, "approach", "fraction", "seed").orderBy("fraction", "seed").collect()
    for point in todo:
        record(run_tfidf(split, point.seed, point.fraction))
    return len(todo)


def abstention(split: DataFrame, recorded: list[str] | None = None, candidates: tuple[float, ...] = model.CANDIDATES) -> dict:
    """Choose a cutoff on validation by a model that has not seen it; refit; score the test rows once.

    If ``recorded`` predictions are given, the refit must give the same.
    """
    train, val, test = parts(split)
    fitted, seen = fit_train_only(split, candidates)
    c, seen = fitted.c, seen.cache()
    points = metrics.sweep(seen)
    cutoff = metrics.select_cutoff(points).first().cutoff
    bins = metrics.reliability(seen)
    gap = metrics.calibration_gap(bins).first()
    refit = model.fit(train.select("text", "chapter").unionByName(val.select("text", "chapter")), c)
    scored = predictions(refit, test).cache()
    if recorded is not None and [r.predicted for r in scored.orderBy("ord").select("predicted").collect()] != recorded:
        raise RefitError("the refit does not give the ledger's predictions")
    row = metrics.sweep(scored, [cutoff]).first().asDict()
    return {"cutoff": cutoff, "points": points, "bins": bins, "mean_gap": gap.mean_gap, "signed_gap": gap.signed_gap, "test": row, "base_accuracy": metrics.accuracy(scored).first().accuracy}
