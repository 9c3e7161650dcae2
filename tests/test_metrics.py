"""Predictions, ledger, service and model."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import dims
from corpusloom.ml import model
from corpusloom.operators import ledger, metrics, reports, service
from corpusloom.sources import files

ROWS = [(0, "a", "a", 0.9), (1, "b", "a", 0.6), (2, "a", "a", 0.4), (3, "b", "b", 0.3)]
SCHEMA = "ord long, y_true string, predicted string, confidence double"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_sweep(spark, four):
    got = {r.threshold: r for r in metrics.sweep(four, [0.0, 0.5, 0.6, 0.61, 2.0]).collect()}
    assert (got[0.0].answered, got[0.0].selective_accuracy, got[0.0].full_accuracy) == (4, 0.75, 0.75)
    assert (got[0.5].answered, got[0.5].selective_accuracy, got[0.5].full_accuracy) == (2, 0.5, 0.25)
    assert got[0.6].answered == 2 and got[0.61].answered == 1
    assert (got[2.0].answered, got[2.0].selective_accuracy, got[2.0].full_accuracy) == (0, None, 0.0)
    assert metrics.select_cutoff(metrics.sweep(four, [0.0, 0.5, 0.7, 0.95]), 0.8).first().cutoff == 0.7
    assert metrics.select_cutoff(metrics.sweep(four), 1.1).first().cutoff == 0.0
    assert metrics.sweep(four.limit(0), [0.5]).first().coverage == 0.0


def test_bins(spark, four):
    low, high = metrics.reliability(four, 2).orderBy("bin").collect()
    assert (low.n, high.n) == (2, 2) and abs(low.mean_confidence - 0.35) < 1e-12 and abs(high.mean_confidence - 0.75) < 1e-12
    assert (low.accuracy, high.accuracy) == (1.0, 0.5)
    edges = spark.createDataFrame([(i, "a", "a", c) for i, c in enumerate((0.58, 0.7, 1.0, 0.0))], SCHEMA)
    bins = [r.bin for r in metrics.reliability(edges).where("n > 0").orderBy("bin").collect()]
    assert bins == [0, 5, 7, 9]
    gap = metrics.calibration_gap(metrics.reliability(four, 2)).first()
    assert abs(gap.mean_gap - 0.45) < 1e-12 and abs(gap.signed_gap + 0.2) < 1e-12


def test_pairs_and_spread(spark):
    y, a, b = "aaaaab", "aaaxxb", "aaxaxx"
    side = lambda p: spark.createDataFrame([(i, t, q, 0.0) for i, (t, q) in enumerate(zip(y, p, strict=True))], SCHEMA)
    found = metrics.paired_outcomes(side(a), side(b)).first()
    assert (found.both_right, found.only_a, found.only_b, found.both_wrong) == (2, 2, 1, 1)
    with pytest.raises(Exception, match="same rows"):
        metrics.paired_outcomes(side(a), side(b).limit(3)).collect()
    s = metrics.spread(spark.createDataFrame([(0.90,), (0.92,), (0.94,)], "v double"), "v").first()
    assert abs(s.mean - 0.92) < 1e-12 and abs(s.stdev - 0.02) < 1e-12
    assert metrics.spread(spark.createDataFrame([(0.5,)], "v double"), "v").first().stdev == 0.0


def test_scores_against_counting(spark, four):
    by = {r.label: r for r in metrics.per_label(four).collect()}
    assert (by["a"].precision, by["a"].recall, by["b"].recall) == (2 / 3, 1.0, 0.5)
    assert abs(metrics.macro_f1(four).first().macro_f1 - (0.8 + 2 / 3) / 2) < 1e-12


def test_verdicts():
    assert ledger.verdict([(0.1, 0.01), (0.2, 0.04)]) == "distinguishable"
    assert ledger.verdict([(0.1, 0.2)]) == "indistinguishable" and ledger.verdict([(0.1, 0.01), (0.1, 0.2)]) == "mixed"
    assert ledger.verdict([(0.1, 0.01), (-0.1, 0.01)]) == "mixed"
    s = [{1}, {1}]
    assert ledger.shape([0.5], [{1}], []) == "incomplete" and ledger.shape([0.5, 0.6], [{1}, {2}], [(0.1, 0.5)]) == "incomplete"
    assert ledger.shape([0.5, 0.502], s, [(0.1, 0.01)]) == "flat" and ledger.shape([0.5, 0.6], s, [(0.1, 0.5)]) == "flattened"
    assert ledger.shape([0.5, 0.6], s, [(0.1, 0.01)]) == "climbing" and ledger.shape([0.6, 0.5], s, [(-0.1, 0.01)]) == "falling"
    assert ledger.shape([0.5, 0.6], s, [(0.1, 0.01), (0.1, 0.5)]) == "mixed"


RUN = {"approach": "tfidf", "seed": 42, "predicted": ["a"], "test_hash": "h", "test_rows": 1, "train_seconds": 1.5, "parameters": 10, "hardware": "x", "recorded": "2026-01-01T00:00:00+00:00", "method": "m", "features": 5, "conditions": {"class_weights": True, "max_tokens": 512}}


def test_ledger_files(spark, tmp_path):
    folder = str(tmp_path / "runs")
    files.record_run(folder, RUN)
    files.record_run(folder, RUN | {"train_seconds": 2.5})
    files.record_run(folder, RUN | {"seed": 43, "fraction": 0.5})
    for name, text in (("bad1.json", "{"), ("bad2.json", "[1]"), ("bad3.json", json.dumps(RUN | {"more": 1})), ("bad4.json", "{}")):
        (tmp_path / "runs" / name).write_text(text)
    good, bad = files.read_ledger(spark, f"{folder}/*.json")
    assert {(r.seed, r.fraction, r.train_seconds) for r in good.collect()} == {(42, 1.0, 2.5), (43, 0.5, 1.5)}
    assert bad.count() == 4
    assert ledger.comparable(good, "h", {"class_weights": True, "max_tokens": 512}, 0.5).count() == 1
    assert ledger.comparable(good, "other").count() == 0


def test_guards(tmp_path):
    with pytest.raises(SystemExit):
        files.inside(str(tmp_path), "/etc/x")
    with pytest.raises(files.SourceError):
        files.safe_path("../x")
    with pytest.raises(ValueError):
        reports.min_confidence(["--min-confidence", "nan"])
    assert reports.min_confidence(["q", "--min-confidence", "1.5"]) == (1.5, ["q"])


def test_policy(tmp_path):
    path = tmp_path / "p.json"
    good = service.make_policy(0.5, "a" * 64, "b" * 64)
    for policy, ok in ((good, True), (good | {"x": 1}, False), (good | {"confidence_threshold": True}, False), (good | {"model_sha256": "z"}, False)):
        path.write_text(json.dumps(policy))
        if ok:
            assert service.load_policy(str(path)) == good
        else:
            with pytest.raises(ValueError):
                service.load_policy(str(path))
    prior = [(s, 1 / 21) for s in dims.SLUGS]
    assert service.answer(prior, 0.0)["answered"] and service.answer(prior, 1 / 21)["answered"] and not service.answer(prior, 0.1)["answered"]
    with pytest.raises(service.ServiceError):
        service.classify(None, None, "q", 0.5, 22)


def test_model_learns_and_ranks(spark, tmp_path):
    words = {"functions": "range domain inverse composite", "vectors-1": "plane line scalar product", "probability": "event dice independent union"}
    rows = [(f"{w} question {i % 3}", c) for c, t in words.items() for i in range(12) for w in (t,)]
    df = spark.createDataFrame(rows, "text string, chapter string")
    fitted = model.fit(df, 10.0)
    assert model.accuracy(fitted, df) == 1.0
    top = fitted.rank(spark.createDataFrame([(1, "the scalar product of a line and a plane")], "id long, text string"), "id", 2).orderBy("rank").collect()
    assert top[0].chapter == "vectors-1" and [r["rank"] for r in top] == [1, 2]
    fitted.save(str(tmp_path / "m"))
    assert model.accuracy(model.ChapterModel.load(str(tmp_path / "m")), df) == 1.0
    assert fitted.answer(df, 1.1).where("answered").count() == 0
    with pytest.raises(ValueError):
        fitted.answer(df, float("nan"))
    payload = service.classify(fitted, spark, "range and domain", 0.0, 3)
    assert payload["answered"] and payload["candidates"][0]["slug"] == "functions"


def test_stream_keeps_latest(spark, tmp_path):
    from corpusloom.streaming import ledger_stream

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, recorded string, v int"
    for n, rows in enumerate(([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        ledger_stream.upsert_stream(spark.readStream.schema(schema).json(source), out, str(tmp_path / "cp"), "k").awaitTermination()
    found = {r.k: r.v for r in ledger_stream.current(spark, out, "k").collect()}
    assert found == {"a": 2, "b": 1}
    assert F is not None


def test_fit_reaches_the_minimum_in_few_passes(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import functions as F

    from corpusloom.ml import regression

    rng = np.random.default_rng(5)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    rows = [(" ".join([*rng.choice(common[k * 8 : k * 8 + 14], 9), *rng.choice(rare, 2), "é" * (i % 2)]), "abc"[k]) for i in range(240) for k in (i % 3,)]
    rows += [("", "a"), (None, "b")]
    df = spark.createDataFrame(rows, "text string, chapter string")
    passes, sums = [], regression._plus
    added = regression._added
    monkeypatch.setattr(regression, "_added", lambda parts, plus: (passes.append(plus is sums), added(parts, plus))[1])
    fitted = model.fit(df)
    assert sum(passes) < 100
    vectors = fitted._vectors(df).withColumn("label", F.ascii("chapter").cast("double") - 97).join(model.groups.class_weights(df).select("chapter", "weight"), "chapter")
    spark_s = LogisticRegression(family="multinomial", weightCol="weight", standardization=False, maxIter=3000, tol=1e-12, regParam=1.0 / len(rows)).fit(vectors)
    assert np.allclose(fitted.classifier.coefficientMatrix.toArray(), spark_s.coefficientMatrix.toArray(), atol=1e-3)
    assert np.allclose(fitted.classifier.interceptVector.toArray(), spark_s.interceptVector.toArray(), atol=1e-3)


def test_terms_are_ranked_by_count_then_text(spark):
    from corpusloom.ml import features

    rows = spark.createDataFrame([(["b", "a", "b"],), (["a", "b"],), (["c"],)], "words array<string>")
    assert [tuple(r) for r in features.vocabulary(rows).collect()] == [("b", 3, 2), ("a", 2, 2), ("a b", 2, 2)][:3]
    assert [r.term for r in features.vocabulary(rows, 2, 1).collect()] == ["b", "a"]
