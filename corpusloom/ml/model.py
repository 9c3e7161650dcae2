"""The classifier: TF-IDF and multinomial logistic regression with balanced weights, as a Spark ML pipeline.

``regParam`` is 1 / (C n): the penalty that C stands for where the loss is a sum over n rows with
balanced weights, whose sum is n. Weights are not standardised.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, SparseVector, Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups, metrics
from ..tables import written
from . import features, regression

#: The candidates of C, iterations, the share of the loss that ends them.
CANDIDATES, ITERATIONS, TOLERANCE = (0.1, 0.5, 1.0, 3.0, 10.0, 30.0), 3000, 1e-8
#: Features of the rows of one block.
BLOCK = 500_000


@F.udf(returnType=VectorUDT())
def _log_counts(v):
    """1 + ln of the counts; sparse vectors have no Arrow form, so this goes row by row."""
    return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))


@dataclass
class ChapterModel:
    """A fitted vocabulary, its frequencies, and the regression."""

    vocabulary: CountVectorizerModel
    scaling: list[float]
    classifier: LogisticRegressionModel
    labels: list[str]
    c: float = 1.0

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return _vectors(self.vocabulary, self.scaling, features.prepared(rows))

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with predicted, confidence and probabilities (in the order of ``labels``); ties go to the first label."""
        found = self.classifier.transform(self._vectors(rows)).withColumn("probabilities", vector_to_array("probability"))
        best = F.array_max("probabilities")
        names = F.array(*[F.lit(x) for x in self.labels])
        return found.select(*rows.columns, "probabilities", best.alias("confidence"), F.get(names, F.array_position("probabilities", best).cast("int") - 1).alias("predicted"))

    def rank(self, rows: DataFrame, key: str, how_many: int = 3) -> DataFrame:
        """key, rank, chapter, probability of the most probable labels; ties go to the later label."""
        names = F.array(*[F.lit(x) for x in self.labels])
        each = self.transform(rows).select(key, F.posexplode("probabilities").alias("class_id", "score"))
        return metrics.top_k(each, how_many, key).select(key, "rank", F.get(names, F.col("class_id")).alias("chapter"), F.col("score").alias("probability"))

    def answer(self, rows: DataFrame, cutoff: float = 0.0) -> DataFrame:
        """:meth:`transform` with ``answered``: whether the confidence reaches the cutoff. A cutoff below 0 or not a number is refused."""
        if not cutoff >= 0.0:
            raise ValueError(f"the cutoff must be 0 or more, got {cutoff}")
        return self.transform(rows).withColumn("answered", F.coalesce(F.col("confidence") >= cutoff, F.lit(False)))

    def parameters(self) -> int:
        """Weights and intercepts."""
        return int(self.classifier.coefficientMatrix.numRows * self.classifier.coefficientMatrix.numCols + self.classifier.interceptVector.size)

    def save(self, path: str) -> None:
        """Write all parts into a new folder under ``path``, then name it in ``path/current``: a reader sees one whole model, old or new."""
        spark = SparkSession.getActiveSession()
        name = uuid.uuid4().hex
        self.vocabulary.write().save(f"{path}/{name}/vocabulary")
        self.classifier.write().save(f"{path}/{name}/classifier")
        spark.createDataFrame([(self.scaling, self.labels, float(self.c))], "scaling array<double>, labels array<string>, c double").coalesce(1).write.parquet(f"{path}/{name}/scaling")
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/current")

    @classmethod
    def load(cls, path: str) -> ChapterModel:
        spark = SparkSession.getActiveSession()
        path = f"{path}/{spark.read.schema('name string').json(f'{path}/current').first().name}"
        row = spark.read.parquet(f"{path}/scaling").first()
        return cls(CountVectorizerModel.load(f"{path}/vocabulary"), list(row.scaling), LogisticRegressionModel.load(f"{path}/classifier"), list(row.labels), row.c)


def _vectors(vocabulary: CountVectorizerModel, scaling: list[float], prepared: DataFrame) -> DataFrame:
    counted = vocabulary.transform(prepared).withColumn("_logs", _log_counts("_counts"))
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(scaling), inputCol="_logs", outputCol="_scaled").transform(counted)
    return Normalizer(p=2.0, inputCol="_scaled", outputCol="features").transform(scaled)


def _blocks(places: Broadcast, labels: dict[str, int], weights: list[float], scaling: np.ndarray):
    """Blocks of rows (chapter, words) for :mod:`regression`; rows without a chapter teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features_ = places.value, len(scaling)

        def block(y: list[int], rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            index, value = (np.concatenate(x) for x in zip(*rows, strict=True))
            found = regression.packed(np.array(y), np.array([weights[k] for k in y]), np.array([len(i) for i, _ in rows]), index, value)
            return pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["block"])

        y, rows, size = [], [], 0
        for batch in batches:
            for chapter, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chapter is None:
                    continue
                counts = Counter(own[t] for t in features.terms_of(words.as_py()) if t in own)
                index = np.fromiter(counts.keys(), np.int64, len(counts))
                value = (1.0 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * scaling[index]
                value /= np.sqrt(value @ value) or 1.0
                y.append(labels[chapter])
                rows.append((np.append(index, features_), np.append(value, 1.0)))
                size += len(index) + 1
                if size >= BLOCK:
                    yield block(y, rows)
                    y, rows, size = [], [], 0
        if y:
            yield block(y, rows)

    return run


def fit(train: DataFrame, c: float = 1.0, max_features: int = features.MAX_FEATURES, min_df: int = features.MIN_DF) -> ChapterModel:
    """The model of ``train`` (text, chapter); vocabulary and frequencies come from these rows alone."""
    spark = train.sparkSession
    rows = written(train.select("chapter", features.words().alias("words")), "words")
    terms = features.vocabulary(rows, max_features, min_df).collect()  # max_features at most
    n = rows.count()
    scaling = [float(np.log((1.0 + n) / (1.0 + t.df))) + 1.0 for t in terms]
    vocabulary = CountVectorizerModel.from_vocabulary([t.term for t in terms], inputCol="terms", outputCol="_counts")
    classes = groups.class_weights(rows).orderBy("chapter").collect()  # one row for each label
    labels = [r.chapter for r in classes]
    places = spark.sparkContext.broadcast({t.term: i for i, t in enumerate(terms)})  # max_features at most
    made = _blocks(places, {x: i for i, x in enumerate(labels)}, [float(r.weight) for r in classes], np.array(scaling))
    blocks = written(rows.mapInArrow(made, "block binary"), "blocks").rdd.map(lambda r: bytes(r.block))
    start = np.zeros((len(labels), len(terms) + 1))
    w = regression.fit(blocks, start, n, 1.0 / (c * n), ITERATIONS, TOLERANCE)
    w[:, -1] -= w[:, -1].mean()
    places.destroy()
    return ChapterModel(vocabulary, scaling, _classifier(spark, w), labels, c)


def _classifier(spark: SparkSession, w: np.ndarray) -> LogisticRegressionModel:
    """Spark's model of these weights, labels x features with the intercepts last."""
    context = spark.sparkContext
    parts = [_py2java(context, x) for x in (Matrices.dense(w.shape[0], w.shape[1] - 1, w[:, :-1].ravel(order="F")), Vectors.dense(w[:, -1]))]
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"LogisticRegression_{uuid.uuid4().hex[:12]}", *parts, w.shape[0], True)
    return LogisticRegressionModel(made)


def accuracy(model: ChapterModel, rows: DataFrame) -> float:
    """The share of rows whose label is predicted."""
    return float(metrics.accuracy(model.transform(rows).withColumn("y_true", F.col("chapter"))).first().accuracy or 0.0)


def choose(train: DataFrame, val: DataFrame, candidates: tuple[float, ...] = CANDIDATES) -> tuple[float, float]:
    """(C, validation accuracy) of the first candidate that scores highest on validation rows."""
    best = max(((accuracy(fit(train, c), val), -i) for i, c in enumerate(candidates)))
    return candidates[-best[1]], best[0]


def tune_and_refit(train: DataFrame, val: DataFrame, candidates: tuple[float, ...] = CANDIDATES) -> tuple[ChapterModel, float]:
    """The model of both splits together, with the C that validation prefers; and that C."""
    c, _ = choose(train, val, candidates)
    return fit(train.select("text", "chapter").unionByName(val.select("text", "chapter")), c), c


def strongest_terms(model: ChapterModel, n: int = 12) -> DataFrame:
    """chapter, term, weight, rank of the largest weights of each label."""
    spark = SparkSession.getActiveSession()
    matrix = model.classifier.coefficientMatrix.toArray()
    rows = [(model.labels[i], model.vocabulary.vocabulary[j], float(matrix[i, j]), k + 1) for i in range(len(model.labels)) for k, j in enumerate(np.argsort(-matrix[i], kind="stable")[:n])]
    return spark.createDataFrame(rows, "chapter string, term string, weight double, rank int")
