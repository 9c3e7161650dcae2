"""Worked values of normalisation, provenance and statistics."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import latex, pages, stats
from corpusloom.functions import text as tx


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_question_numbers(spark):
    rows = [("Q11",), ("11",), ("11(a)",), ("Q11(a)",), ("  Q 11 ( a)",), ("9 (modified)",), ("",), (None,), (" Abc ",)]
    found = values(spark, rows, "n string", tx.normalise_question_number(F.col("n")))
    assert [x for (x,) in found] == ["11", "11", "11a", "11a", "11a", "9m", None, None, "abc"]


def test_papers(spark):
    found = values(spark, [(x,) for x in ("I", "p 2", "II", "III", "3", "1", "", None)], "p string", tx.normalise_paper(F.col("p")))
    assert [x for (x,) in found] == ["P1", "P2", "P2", "P3", "3", "P1", None, None]


def test_comparable_and_normal_text(spark):
    found = values(spark, [("A  b\n",), (None,), ("x--Y  1.",)], "t string", tx.normalise_question("t"), tx.comparable_text("t"))
    assert found == [("A b", "a b"), ("", ""), ("x--Y 1.", "x y 1")]


def test_group_keys(spark):
    rows = [("S", 2020, "II", "f", "a:1"), ("", None, None, "f", "a:2"), (None, None, None, "f", "a:3"), (None, None, None, "", "tut:apgp:q01"), (None, None, None, None, "orphan"), (None, None, None, None, None)]
    key = tx.leakage_group_key(*[F.col(c) for c in ("s", "y", "p", "f", "i")])
    found = [r.k.asDict() for r in spark.createDataFrame(rows, "s string, y int, p string, f string, i string").select(key.alias("k")).collect()]
    assert [(k["kind"], k["school"], k["year"], k["paper"], k["ref"]) for k in found] == [
        ("paper", "S", 2020, "P2", None), ("paper", "", None, None, None), ("file", None, None, None, "f"), ("file", None, None, None, "tut:apgp"), ("row", None, None, None, "orphan"), ("row", None, None, None, ""),
    ]


def test_wilson(spark):
    low, high = stats.wilson_interval(F.col("k"), F.col("n"))
    found = values(spark, [(229, 246), (246, 246)], "k int, n int", low, high)
    assert (round(found[0][0], 4), round(found[0][1], 4)) == (0.8921, 0.9564)
    assert found[1][1] == 1.0 and 0.98 < found[1][0] < 1
    for bad in ((1, 0), (3, 2), (-1, 2)):
        with pytest.raises(Exception, match="interval needs|correct must"):
            values(spark, [bad], "k int, n int", low)


def test_mcnemar(spark):
    pairs = spark.createDataFrame([(4, 4), (0, 0), (5, 1), (1, 5), (10, 0), (11, 8), (300, 290)], "only_a long, only_b long")
    found = {(r.only_a, r.only_b): r.p for r in stats.mcnemar(pairs).collect()}
    exact = lambda a, b: min(1.0, 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
    for (a, b), p in found.items():
        assert abs(p - exact(a, b)) < 1e-9
    assert len(found) == 7 and abs(found[5, 1] - 14 / 64) < 1e-12 and found[0, 0] == 1.0


def test_paired_difference(spark):
    low, high = stats.paired_difference_interval(F.lit(8), F.lit(4), F.lit(246))
    (a, b), = values(spark, [(1,)], "x int", low, high)
    assert abs((a + b) / 2 - 4 / 246) < 1e-12
    assert abs((b - a) - 2 * 1.959964 * math.sqrt((12 - 16 / 246) / 246**2)) < 1e-12


def test_prose():
    assert latex.prose(r"Find $\frac{1}{\sqrt{2}}$ % note" "\n" r"and 5\% of \$3")[0] == "Find 1 / square root of 2 and 5% of $3"
    assert latex.prose(r"\sqrt[3]{x} \le \pi, \textbf{bold} \unknowncmd 90^\circ") == ("root 3 of x <= pi , bold 90 degrees", ["unknowncmd"])
    assert latex.prose(r"\begin{tikzpicture}[x] junk \end{tikzpicture}a \{b\} \frac{1}")[0] == "a {b} {1}".replace("{1}", "1")
    assert latex.prose(r"a \sqrt[3 b")[0] == "a [3 b"


def test_tag():
    fields, modified, rest = latex.provenance("2024 / ABCJC / JC2 / Prelim / P2 / Q1 (modified)")
    assert modified and not rest
    assert fields == {"year": 2024, "school": "ABCJC", "level": "JC2", "exam": "Prelim", "paper": "P2", "question_no": "Q1"}
    assert latex.provenance("ABCJC JC2 Revision Package")[0]["exam"] == "Revision Package"
    assert latex.provenance("2024 / 9740 / vectors")[2] == ["9740", "vectors"]


@pytest.mark.parametrize(
    ("tag", "expected"),
    [
        ("2013/Prelim/ABCJC/II/5", (2013, "ABCJC", None, "Prelim", "II", "5")),
        ("2013/DEFJC/I/Q6", (2013, "DEFJC", None, None, "I", "6")),
        ("GHIJC/Prelim2013/P2/Q3", (2013, "GHIJC", None, "Prelim", "P2", "3")),
        ("JKLJC/2013/Prelim/P1/Q2", (2013, "JKLJC", None, "Prelim", "P1", "2")),
        ("XYZMI/2013/Prelim/PU3/P2/Q1", (2013, "XYZMI", "PU3", "Prelim", "P2", "1")),
        ("ABCJC/2013/Promo/Q4", (2013, "ABCJC", None, "Promo", None, "4")),
        ("ABCJC/2013/P1/Q4", (2013, "ABCJC", None, None, "P1", "4")),
        ("Prelim 2015/MNOJC/P2/11", (2015, "MNOJC", None, "Prelim", "P2", "11")),
        ("2015 PQRJC Prelim P2/10", (2015, "PQRJC", None, "Prelim", "P2", "10")),
        ("a/b/c", (None,) * 6),
        (None, (None,) * 6),
    ],
)
def test_page_provenance(tag, expected):
    f = pages.page_provenance(tag)
    assert (f["year"], f["school"], f["level"], f["exam"], f["paper"], f["question_no"]) == expected


def test_tutorial_questions():
    body = "\\Q one\n\\qend{3}\n% \\Q not\n\\Q two\nmore\n\\embersection{x}\nlost\n\\Q three"
    assert latex.tutorial_questions(body) == ["\\Q one\n\\qend{3}", "\\Q two\nmore", "\\Q three"]


def test_page_text(spark):
    df = spark.createDataFrame([("a\n 5 \nb\n5\ngarbled", 4), ("none", 4)], "t string, p int")
    assert [r[0] for r in df.select(pages.without_tail(F.col("t"), F.col("p"))).collect()] == ["a\n 5 \nb\n", "none"]
    text = F.lit("H2 MATHEMATICS\nﬁnd x§\n9758\n y\x03z")
    assert df.select(pages.clean_text(text, pages.TUTORIAL_LINES, True)).first()[0] == "find x y z"
    assert df.select(pages.book_text(F.lit("12\nTitle\nreal 3\n"), ["Title"])).first()[0] == "real 3"
    assert df.select(pages.question_part(F.lit("ask this\n∗∗∗∗∗\nSolution. no"))).first()[0] == "ask this"


def test_marks(spark):
    rows = [(r"a \mk{2} b \mk{3}", ), ("none",)]
    assert values(spark, rows, "t string", tx.marks(F.col("t"))) == [(5,), (None,)]
    rows = [(r"x \qend{7}",), (r"x \hfill\textbf{[6]}",), ("x",)]
    assert values(spark, rows, "t string", tx.tutorial_marks(F.col("t"))) == [(7,), (6,), (None,)]
    assert values(spark, [("Tutorial B1A", 3)], "s string, n int", tx.problem_id(F.col("s"), F.col("n"))) == [("triplemath-tutorial-b1a-p03",)]
