"""LaTeX folders, truth files, extractions and sinks."""

import json

import pytest

from corpusloom.operators import corpus
from corpusloom.sources import files


def test_revision_packages(spark, tmp_path):
    parts = tmp_path / "PnC" / "parts"
    parts.mkdir(parents=True)
    (parts / "p1_q.tex").write_text("\\Q Choose $n$ \\mk{2}\\mk{3}\n\\qend{2024 / ABCJC / JC2 / Prelim / P2 / Q1}")
    rows = files.revision_packages(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.chapter, r.year, r.school, r.paper, r.marks, r.text) == ("rp:PnC:p1", "permutations-and-combinations", 2024, "ABCJC", "P2", 5, "Choose n")
    (parts / "p2_q.tex").write_text("no tag")
    with pytest.raises(Exception, match="exactly one qend"):
        files.revision_packages(spark, str(tmp_path)).collect()


def test_tutorials(spark, tmp_path):
    folder = tmp_path / "functions"
    folder.mkdir()
    (folder / "t.tex").write_text("\\newcommand{\\Q}{x}\n\\begin{document}\n\\Q first \\hfill\\textbf{[6]}\n\\qend{7}\n\\Q second \\textbf{[4]}\n")
    (folder / "t_Solutions.tex").write_text("\\begin{document}\n\\Q answer")
    rows = files.tutorials(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.marks, r.text) for r in rows] == [("tut:functions:q01", 7, "first"), ("tut:functions:q02", 4, "second [4]")]


def test_extractions_and_sinks(spark, tmp_path):
    for name, n in (("a", 2), ("b", 1)):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(json.dumps({"id": f"{name}{i}", "text": "x"}) for i in range(n)) + "\n")
    rows = files.read_extractions(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert [r.id for r in rows.orderBy("ord").collect()] == ["a0", "a1", "b0"]
    with pytest.raises(FileNotFoundError):
        files.read_extractions(spark, [str(tmp_path / "none.jsonl")])
    files.write_jsonl(rows, str(tmp_path / "out"), str(tmp_path))
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(corpus.CorpusError):
        corpus.require_unique_ids(rows.unionByName(rows))


def test_truth(spark, tmp_path):
    case = {"pdf": "x.pdf", "label": "l", "held_out": False, "pages": [0, 1], "note": "", "questions": [{"n": 1, "pages": [0]}, {"n": 2, "pages": [0, 1]}]}
    (tmp_path / "t.json").write_text(json.dumps({"case": case}, indent=1))
    rows = files.read_truth(spark, str(tmp_path / "t.json")).orderBy("number").collect()
    assert [(r.paper_id, r.number, r.start_page, list(r.pages)) for r in rows] == [("case", 1, 0, [0]), ("case", 2, 0, [0, 1])]
