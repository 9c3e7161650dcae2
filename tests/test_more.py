"""Ledger comparisons, report sections, row checks, splits of single rows, configuration and the command line."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as cli
from corpusloom import dims
from corpusloom.config import Config
from corpusloom.functions import latex
from corpusloom.operators import corpus, groups, ledger, metrics, reports, service, split
from corpusloom.sources import files


def test_dealt_against_one_at_a_time():
    def plain(need, rows):
        left, out = list(need), [0, 0, 0]
        for _ in range(rows):
            s = max(range(3), key=lambda k: (round(left[k], 9), -k))
            out[s] += 1
            left[s] -= 1
        return out

    for need in ([7.0, 1.5, 1.5], [0.0, 0.0, 0.0], [-5.0, 90.25, 3.0], [700.0, 150.0, 150.0]):
        for rows in (0, 1, 5, 64, 65, 100, 1_000):
            assert split.dealt(need, rows) == plain(need, rows), (need, rows)


def test_single_rows_are_dealt_whole(spark):
    rows = spark.range(3_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"), F.col("id").alias("ord"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("chapter"), *[F.lit(None).cast(t).alias(c) for c, t in (("school", "string"), ("year", "int"), ("paper", "string"), ("source_file", "string"), ("text", "string"))])
    labels = spark.createDataFrame([(0, "a", "A"), (1, "b", "B")], "class_id int, slug string, name string")
    found = split.split_rows(rows, labels=labels)
    split.check(rows, found, labels)
    assert {(r.chapter, r.split): r["count"] for r in found.groupBy("chapter", "split").count().collect()} == {(c, s): n for c in "ab" for s, n in (("train", 1050), ("val", 225), ("test", 225))}
    half = groups.subsample(found, 0.5)
    assert {r.split: r["count"] for r in half.groupBy("split").count().collect()} == {"train": 1050, "val": 225, "test": 450}


def test_percentiles_against_sorting(spark):
    values = [i * i % 1_009 / 7 for i in range(5_000)]
    found = {r.share: r.value for r in metrics.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 1, 50, 99, 100]).collect()}
    ordered = sorted(values)
    assert found == {s: ordered[max(min(round(s / 100 * len(values)), len(values)) - 1, 0)] for s in (0, 1, 50, 99, 100)}
    assert metrics.percentiles(spark.createDataFrame([], "v double"), "v", [50]).count() == 0


def test_last_step_and_shapes(spark):
    truth = spark.createDataFrame([(i, "a") for i in range(20)], "ord int, y_true string")
    runs = [("t", f, s, ["a" if i < n else "b" for i in range(20)]) for f, n in ((0.5, 8), (1.0, 18)) for s in (42, 43)] + [("t", 1.0, 44, ["a"] * 20), ("u", 1.0, 42, ["a"] * 20)]
    runs = spark.createDataFrame(runs, "approach string, fraction double, seed int, predicted array<string>")
    pairs = ledger.last_step(ledger.answers(runs, truth)).orderBy("seed").collect()
    assert [(r.approach, r.seed, r.both, r.only_a, r.only_b, r.neither) for r in pairs] == [("t", 42, 8, 0, 10, 2), ("t", 43, 8, 0, 10, 2)]
    assert all(abs(r.p - 2 / 1024) < 1e-12 and abs(r.difference - 0.5) < 1e-12 for r in pairs)
    curve = lambda name, means, seeds: {"name": name, "means": means, "seeds": seeds}
    both = [{42, 43}, {42, 43}]
    assert ledger.curves_differ(curve("x", [0.5, 0.9], both), curve("y", [0.5, 0.8], both)) == "x"
    assert ledger.curves_differ(curve("x", [0.5, 0.9], both), curve("y", [0.6, 1.0], both)) == "alike"
    assert ledger.curves_differ(curve("x", [0.5, 0.9], both), curve("y", [0.6, 1.0], [{42}, {42}])) == "incomplete"
    records = spark.createDataFrame([("t", 43, None), ("t", 44, 9), ("u", 42, 5), ("u", 41, 6)], "approach string, seed int, train_rows int")
    assert {r.approach: (r.seed, r.train_rows) for r in ledger.default_run(records, "approach").collect()} == {"t": (43, None), "u": (42, 5)}
    assert [r.n for r in records.select(ledger.rows_trained_on(100).alias("n")).collect()] == [100, 9, 5, 6]


def test_row_faults_stop_a_write(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "functions", "t", "r"), ("b", 1, None, "t", "r")], "id string, ord long, chapter string, text string, raw_text string")
    corpus.require_sound(rows, dims.labels(spark))
    files.write_corpus(rows, str(tmp_path / "c"), str(tmp_path / "u"), str(tmp_path))
    assert spark.read.json(str(tmp_path / "c")).count() == 1 and spark.read.json(str(tmp_path / "u")).first().id == "b"
    bad = rows.unionByName(rows.limit(1)).withColumn("raw_text", F.lit("\\Sol"))
    assert sorted({r.fault for r in corpus.row_faults(bad, dims.labels(spark)).collect()}) == ["repeated id", "solution marks"]
    with pytest.raises(corpus.CorpusError):
        corpus.require_sound(bad, dims.labels(spark))
    with pytest.raises(corpus.CorpusError):
        files.write_corpus(bad, str(tmp_path / "x"), str(tmp_path / "y"))
    assert not (tmp_path / "x").exists()


def test_sections(spark):
    pairs = spark.createDataFrame([(42, 1, 2, 3, 4, 0.1, 0.5)], "seed int, both int, only_a int, only_b int, neither int, difference double, p double")
    assert "| 42 | 1 | 2 | 3 | 4 | +10.0 points | 0.50 |" in reports.comparison_section("One", "Two", pairs, "mixed")
    assert "95.0%" in reports.resplit_section([(19, 20), (19, 20)]) and reports.curves_sentence("Two") == "More data helps Two more."
    points = spark.createDataFrame([(0.5, 10.0, 0.8, None), (1.0, 20.0, 0.9, 0.1)], "fraction double, train_rows double, mean double, step double")
    section = reports.curve_section("One", points, "flattened", pairs)
    assert "| 50% | 10 | 80.0% | - |" in section and "flattened" in section
    ranked = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.1)], "question string, rank int, chapter string, probability double")
    assert "| q | a (90 %), b (10 %) |" in reports.example_table(ranked)
    coverage = spark.createDataFrame([("t", 1.0, [42, 43])], "approach string, fraction double, seeds array<int>")
    assert reports.seeds_sentence(coverage) == "t at 100%: seeds 42 and 43."
    assert reports.report("R", "a", "b").startswith("# R\n")


def test_configuration_and_classifier(tmp_path):
    assert Config.read({"CORPUSLOOM_MODEL_PATH": "relative", "CORPUSLOOM_BOOK_PATH": "/b.pdf"}) == Config(book_path="/b.pdf")
    model, policy = tmp_path / "m", tmp_path / "p.json"
    model.write_text("weights")
    policy.write_text(json.dumps(service.make_policy(0.25, service.file_sha256(str(model)), "b" * 64)))
    loads = []
    ready = service.Classifier(str(model), str(policy), lambda path: loads.append(path) or "model")
    assert (ready.model, ready.cutoff, ready.fault, len(loads)) == ("model", 0.25, None, 1)
    model.write_text("others")
    for broken in (service.Classifier(str(model), str(policy), lambda path: "model"), service.Classifier(None, None, lambda path: "model"), service.Classifier(str(model), str(policy), lambda path: 1 / 0)):
        with pytest.raises(service.ServiceError) as error:
            broken.classify(None, "question")
        assert error.value.code == "model_unavailable" and str(tmp_path) not in error.value.safe_message
    for path, code in (("x.txt", "invalid_input"), ("", "invalid_input"), (None, "invalid_input"), ("/nowhere/x.pdf", "paper_unreadable")):
        with pytest.raises(service.ServiceError) as error:
            service.readable_paper(path)
        assert error.value.code == code
    assert service.policy_faults([]) == ["not an object"] and service.policy_faults({"x": 1})[-1] == "unknown x"


class Ranked:
    """A stand-in for a fitted model."""

    def rank(self, rows, key, how_many):
        best = [("functions", 0.75), ("probability", 0.25)][:how_many]
        return rows.select(key, F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(s).alias("chapter"), F.lit(p).alias("probability")) for i, (s, p) in enumerate(best)])).alias("r")).select(key, "r.*")


def test_command_line(spark, monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(cli, "_model", lambda config: Ranked())
    cli.main(["classify", "--min-confidence", "0.9", "--top", "1", "Find the range"], spark, Config())
    out = capsys.readouterr().out
    assert "not answered" in out and "75.0%" in out
    for bad in (["classify", "--min-confidence", "nan", "q"], ["nothing"], []):
        with pytest.raises((SystemExit, ValueError)):
            cli.main(bad, spark, Config())
    with pytest.raises(SystemExit):
        cli.main(["classify", "  "], spark, Config())
    (tmp_path / "t.json").write_text(json.dumps({"p": {"pdf": "p.pdf", "pages": [0], "questions": [{"n": 1, "pages": [0]}, {"n": 2, "pages": [0]}]}}))
    (tmp_path / "q.json").write_text(json.dumps({"paper_id": "p", "number": 1, "start_page": 0, "pages": [0], "text": "x"}))
    cli.main(["score", str(tmp_path / "t.json"), str(tmp_path / "q.json")], spark, Config())
    assert "found 1 of 2, exact pages 1, spurious 0" in capsys.readouterr().out
    found = spark.createDataFrame([("p", 1, [0, 1])], "paper_id string, number int, pages array<int>")
    assert files.label_skeleton(found, "a.pdf", "a", [0, 1])["a"]["questions"] == [{"n": 1, "pages": [0, 1]}]
    recipe = spark.createDataFrame([("p", [1, 0])], "paper_id string, kept array<int>")
    assert files.renumbered(found, recipe).first().pages == [1, 0]


def test_papers_are_classified_in_one_pass(spark):
    lines = [(f"p{k}", n, n // 2, 842.0, 50.0, 100.0 + 100 * (n % 2), 0.0, 0.0, 11.0, f"{n + 1}. ask {n} and some more words to read") for k in range(2) for n in range(4)]
    lines = spark.createDataFrame(lines, "paper_id string, ord long, page int, page_height double, x0 double, y0 double, x1 double, y1 double, size double, text string")
    found = service.classify_paper(Ranked(), lines, lines.select("paper_id", "page").distinct(), 2, 0.5, strict=False).collect()
    assert len(found) == 16 and all(r.answered for r in found) and {r.number for r in found} == {1, 2, 3, 4}


def test_reader_reads_each_part_once():
    deep = r"\frac{" * 5_000
    assert latex.prose(deep)[0] == "" and latex.prose("{" * 100_000)[0] == ""
    assert latex.prose(r"\text{a \mk{3} b} \sqrt[n]{\frac{x}{y}} \vspace{1cm}c \foo \bar{z}") == ("a b root n of x / y c z", ["foo"])


def test_long_tfidf_shuffles_chunks_not_words(spark, monkeypatch):
    import math
    from collections import Counter, defaultdict

    from corpusloom.ml import features

    monkeypatch.setattr(features, "CHUNK", 4)
    rows = [(i, "xy"[i % 2], f"Word{i % 3} word{i % 4} word1 ß_é a alone{i}") for i in range(40)]
    rows += [(5, "y", "word1 word9"), (5, "x", "word2 word2"), (None, "x", "word1 word2"), (None, "x", "word3"), (None, None, "word3"), (50, "x", None), (51, "x", "")]
    df = spark.createDataFrame(rows, "id long, chapter string, text string")
    counts = defaultdict(Counter)
    for i, c, t in rows:
        counts[i, c].update(re.findall("[a-z0-9_]{2,}", (t or "").lower()))
    seen = Counter(t for c in counts.values() for t in c)
    v = {(i, c, t): (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + seen[t])) + 1) for (i, c), own in counts.items() for t, n in own.items() if seen[t] >= 2}
    norm = Counter()
    for (i, _, _), x in v.items():
        norm[i] += x * x
    got = features.long_tfidf(df, "id")
    found = {(r.id, r.chapter, r.term): r.tfidf for r in got.collect()}
    assert got.count() == len(found) and found.keys() == v.keys()
    assert all(abs(found[k] - x / math.sqrt(norm[k[0]])) < 1e-12 for k, x in v.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) <= {"chunk", "term"} and "Generate" in plan
    assert features.long_tfidf(df.where("id > 49"), "id").count() == 0 and features.long_tfidf(df.where("id > 99"), "id").count() == 0
