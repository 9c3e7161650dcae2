"""Segmentation rules on synthetic lines."""

import pytest

from corpusloom import schemas
from corpusloom.operators import reader


def line(text, y, x=50.0, page=0, size=11.0, height=842.0):
    return {"text": text, "y0": float(y), "x0": float(x), "page": page, "size": size, "page_height": height}


def frames(spark, papers):
    rows = [("p" + str(k), i, r["page"], r["page_height"], r["x0"], r["y0"], r["x0"], r["y0"], r["size"], r["text"]) for k, lines in enumerate(papers) for i, r in enumerate(lines)]
    lines = spark.createDataFrame(rows, schemas.LINE)
    pages = [("p" + str(k), p) for k, ls in enumerate(papers) for p in range(max((r["page"] for r in ls), default=0) + 1)]
    return lines, spark.createDataFrame(pages, "paper_id string, page int")


def cut(spark, *papers, **options):
    lines, pages = frames(spark, papers)
    counts = pages.groupBy("paper_id").count().withColumnRenamed("count", "page_count")
    found, columns = reader.segment(lines, counts, **options)
    out = {}
    for r in found.orderBy("paper_id", "number").collect():
        out.setdefault(int(r.paper_id[1:]), []).append((r.number, list(r.pages), r.text))
    return out, {int(r.paper_id[1:]): r for r in columns.collect()}


def test_columns_and_sequences(spark):
    indented = [line("1 a", 100), line("12 cm", 130, 90), line("2 b", 200), line("3 c", 300)]
    learnt = [line(f"{n} q", 100 * n, 123) for n in (1, 2, 3)]
    two = [line("1 a", 100, 10), line("2 b", 200, 20)]
    stray = [line("1 a", 100), line("7 x", 150), line("2 b", 200), line("body", 250)]
    later = [line("3 a", 100), line("4 b", 200), line("5 c", 300)]
    found, columns = cut(spark, indented, learnt, two, stray, later)
    assert [n for n, _, _ in found[0]] == [1, 2, 3] and found[0][0][2] == "a 12 cm"
    assert columns[0].intercept == 50.0 and columns[1].intercept == 123.0
    assert 2 not in found and 2 not in columns and 4 not in found
    assert [n for n, _, _ in found[3]] == [1, 2] and found[3][0][2] == "a 7 x"


@pytest.mark.parametrize("mark", [". ", ") ", " ", "\t"])
def test_separators(spark, mark):
    found, _ = cut(spark, [line(f"{n}{mark}q", 100 * n) for n in (1, 2, 3)])
    assert [n for n, _, _ in found[0]] == [1, 2, 3]


def test_stops_and_pages(spark):
    stop = [line("1 a", 100), line("Section B: statistics", 150), line("intro", 170), line("2 b", 200), line("3 c", 300)]
    ends = [line("1 a", 100), line("2 b", 200), line("3 c", 300), line("BLANK PAGE", 400, page=1), line("tail", 450, page=1)]
    breaks = [line("1 a", 100), line("2 b", 200), line("goes on", 300, page=1), line("3 c", 400, page=1)]
    silent = [line("1 a", 100), line("x", 300, 90, 1), line("y", 300, 90, 2), line("2 b", 200, page=3), line("3 c", 300, page=3)]
    top = [line("1 a", 100), line("2 b", 200), line("3 c", 300), line("tall", 60, 90, 1), line("4 d", 95, page=1)]
    found, _ = cut(spark, stop, ends, breaks, silent, top)
    assert found[0][0][2] == "a" and [n for n, _, _ in found[0]] == [1, 2, 3]
    assert found[1][2] == (3, [0], "c")
    assert [p for _, p, _ in found[2]] == [[0], [0, 1], [1]]
    assert found[3][0][1] == [0, 1, 2]
    assert found[4][3] == (4, [1], "d tall")


def test_furniture(spark):
    lines = [line("head", 20), line("foot", 0.95 * 842), line("." * 40, 300), line("tiny", 300, size=4.0), line("null size", 300, size=None)]
    paper = [line("Repeated text", 400, page=p) for p in range(4)] + [line("1", 500, page=p) for p in range(4)]
    frame, pages = frames(spark, [lines, paper])
    counts = pages.groupBy("paper_id").count().withColumnRenamed("count", "page_count")
    found = {(r.paper_id, r.ord): r.furniture for r in reader.with_furniture(frame, counts).collect()}
    assert [found["p0", i] for i in range(5)] == [True, True, True, True, False]
    assert [found["p1", i] for i in range(8)] == [True] * 4 + [False] * 4


def test_skew(spark):
    paper = [line(f"{n} q", 500 * n, 130 + 0.0122 * 500 * n, height=2339.0) for n in (1, 2, 3, 4)]
    plain, _ = cut(spark, paper, tolerance=8.0)
    skewed, columns = cut(spark, paper, tolerance=8.0, skew=True)
    assert 0 not in plain
    assert [n for n, _, _ in skewed[0]] == [1, 2, 3, 4] and abs(columns[0].slope - 0.0122) < 1e-9


def test_reports(spark):
    good = [line(f"{n} some text of a question", 100 * n) for n in (1, 2, 3)]
    wide = [line("1 a", 100), line("2 b", 200), line("3 c", 300)] + [line(f"text of page {p}", 300, 90, p) for p in range(1, 6)]
    lines, pages = frames(spark, [good, [], wide])
    found, report = reader.read_papers(lines, pages, rung=1, strict=False)
    by = {r.paper_id: r for r in report.collect()}
    assert by["p0"].trustworthy and by["p0"].questions == 3 and by["p0"].pages_read == [0]
    assert by["p1"].problems == ["no questions found"] and by["p1"].pages_without_text_layer == [0]
    assert by["p2"].oversized_questions[0].number == 3 and not by["p2"].trustworthy
    with pytest.raises(reader.PaperReadError) as caught:
        reader.read_papers(lines, pages, rung=1)
    assert caught.value.report["problems"]
    with pytest.raises(ValueError, match="rung 3"):
        reader.read_papers(lines, pages, rung=3)


@pytest.mark.parametrize(("chars", "rung"), [([2091, 1451, 1441], 1), ([0, 0, 0], 2), ([2091, 0, 1441], 1), ([0, 0, 1441], 2)])
def test_rungs(spark, chars, rung):
    counts = spark.createDataFrame([("p", i, c) for i, c in enumerate(chars)], "paper_id string, page int, chars int")
    assert reader.rungs(counts).first().rung == rung


def test_page_specs():
    assert reader.parse_pages("0-2,5") == [0, 1, 2, 5] and reader.parse_pages("") is None
