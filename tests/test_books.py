"""Printed sources and experiments on small made-up books."""

import pytest
from pyspark.sql import functions as F

from corpusloom.ml import runs
from corpusloom.operators import books


def test_bank(spark):
    pages = [
        (1, "Topic 1\nArithmetic & Geometric Progressions\nQ1. Find the sum\n[2013/Prelim/ABCJC/II/5]\nunnumbered question starts\n2\n"),
        (2, "goes on\n[ABCJC/2013/Promo/Q4]\nnext body\nQ2. Second § one\n3\ngarbled"),
        (3, "Answers\n1. 5"),
        (4, "\x03\x03\x03\x03 solution Q1."),
        (41, "Topic 2\nQ1. Expand"),
    ]
    rows = books.bank_questions(spark.createDataFrame(pages, "page int, text string")).orderBy("id").collect()
    assert [r.id for r in rows] == ["topical-t01-q001", "topical-t01-q002", "topical-t01-q003", "topical-t02-q001"]
    assert (rows[0].text, rows[0].year, rows[0].school, rows[0].page) == ("Find the sum unnumbered question starts goes on", 2013, "ABCJC", 1)
    assert (rows[1].exam, rows[1].question_no, rows[1].text) == ("Promo", "4", "next body") and rows[2].text == "Second one"
    assert rows[3].chapter is None and rows[3].topic == "Binomial Thoerem"
    with pytest.raises(books.BookError, match="does not open topic 3"):
        books.bank_questions(spark.createDataFrame([*pages, (58, "Q1. no heading")], "page int, text string"))
    with pytest.raises(books.BookError):
        books.bank_questions(spark.createDataFrame([*pages, (5, "Q3. late")], "page int, text string"))


def test_tutorials(spark):
    pages = [("PNC", 0, "H2 MATHEMATICS\n1.\nfirst ﬁnd\n25.\nstill\n2.\nsecond\n1\n"), ("PNC", 1, "tail\n2\nx")]
    rows = books.tutorial_questions(spark.createDataFrame(pages, "source string, page int, text string")).orderBy("id").collect()
    assert [(r.id, r.chapter, r.text) for r in rows] == [("tutorial-pnc-q01", "permutations-and-combinations", "first find 25. still"), ("tutorial-pnc-q02", "permutations-and-combinations", "second tail")]


def test_book(spark):
    toc = [(0, 1, "Part", 1), (1, 2, "B3 Functions", 1), (2, 3, "Tutorial B3", 1), (3, 3, "Self-Practice B3", 2), (4, 2, "Other", 3), (5, 3, "x", 3)]
    toc = spark.createDataFrame(toc, "ord int, level int, title string, page int")
    text = [(1, "Problem 1. ask a\nSolution. no\nProblem 2. ask\nB3 Functions\n7\n"), (2, "more b\n∗∗∗∗∗\nProblem 1. ask c\n"), (3, "Problem 9. elsewhere")]
    pages = spark.createDataFrame(text, "page int, text string")
    rows = books.book_problems(pages, toc).orderBy("page", "id").collect()
    assert [(r.id, r.page, r.subsection, r.text) for r in rows] == [("triplemath-tutorial-b3-p01", 1, "Tutorial", "ask a"), ("triplemath-tutorial-b3-p02", 1, "Tutorial", "ask more b"), ("triplemath-self-practice-b3-p01", 2, "Self-Practice", "ask c")]
    with pytest.raises(Exception, match="restarts"):
        books.book_problems(pages.withColumn("text", F.when(F.col("page") == 2, "none").otherwise(F.col("text"))), toc).collect()


def test_runs(spark):
    words = {"functions": "range domain inverse", "vectors-1": "plane line product", "probability": "event dice union"}
    rows = [(f"{c}:{k}:{i}", n, c, f"{t} {'alpha beta gamma'.split()[i % 3]}", part, f"f{k}") for n, (c, t, k, i, part) in enumerate((c, t, k, i, p) for c, t in words.items() for k, p in enumerate(["train"] * 4 + ["val", "test"]) for i in range(4))]
    split = spark.createDataFrame(rows, "id string, ord long, chapter string, text string, split string, source_file string")
    split = split.withColumns({"school": F.lit(None).cast("string"), "year": F.lit(None).cast("int"), "paper": F.lit(None).cast("string")})
    from corpusloom.operators import groups

    split = groups.with_group_key(split).cache()
    record = runs.run_tfidf(split, candidates=(1.0,))
    assert record["test_rows"] == 12 and record["train_rows"] == 60 and len(record["predicted"]) == 12
    found = runs.abstention(split, record["predicted"], candidates=(1.0,))
    assert found["base_accuracy"] == 1.0 and found["test"]["total"] == 12
    with pytest.raises(runs.RefitError):
        runs.abstention(split, ["x"] * 12, candidates=(1.0,))
    done = spark.createDataFrame([("tfidf", 1.0, s) for s in (42, 43, 44)], "approach string, fraction double, seed int")
    made = []
    assert runs.learning_curve(split, done, made.append, fractions=(1.0,)) == 0 and not made
