"""Text of printed pages: tails, provenance shapes, section restarts, cleaning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latex import TAG_FIELDS
from .text import PROVENANCE_LINE

# Glyphs that symbol fonts leave behind, ligatures, running lines.
BANK_GLYPHS = "§¨©ª«¬®¯±³´¶·¸¹º»¼½¾¿¦"
JUNK = r"[\x00-\x09\x0b-\x1f\x7f-\x9f\xadഀ-ൿ-]"
BOOK_JUNK = r"[-\x00-\x09\x0b-\x1f]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
TUTORIAL_LINES = (r"Tutorial\s*[—|].*", r"H2 MATHEMATICS", r"·", r"9758", r"♦.*")
BANK_LINES = (r"Topic\s+\d+", r"Level\s*[123]", r"[τ-ύ\s]{1,6}")
PROBLEM, SOLUTION, SEPARATOR = r"(?m)^Problem (\d+)\.", r"(?m)^Solution\.", "∗∗∗∗∗"


def without_tail(text: Column, page: Column) -> Column:
    """Cut from the last line that is the printed page number (the page index plus one)."""
    number = (page + 1).cast("string")
    lines = F.split(text, "\n")
    at = F.array_max(F.filter(F.transform(lines, lambda line, i: F.when(F.trim(F.regexp_replace(line, r"\s", " ")) == number, i)), lambda i: i.isNotNull()))
    return F.when(at.isNull(), text).when(at == 0, "").otherwise(F.concat(F.array_join(F.slice(lines, F.lit(1), at), "\n"), F.lit("\n")))


def clean_text(text: Column, drop: tuple[str, ...] | list[str], glyphs: bool) -> Column:
    """Without the lines that match a pattern in full, without glyph junk, ligatures spelt out, white space collapsed."""
    whole = "|".join(f"(?:{p})" for p in drop)
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda line: ~F.regexp_replace(line, r"(?U)^\s+|\s+$", "").rlike(rf"\A(?:{whole})\z")) if drop else lines
    out = F.regexp_replace(F.array_join(kept, "\n"), JUNK, " ")
    if glyphs:
        out = F.regexp_replace(out, f"[{BANK_GLYPHS}]", " ")
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def bank_lines(topic: str) -> list[str]:
    """The running lines of one topic of the bank."""
    return [*BANK_LINES, PROVENANCE_LINE, r"\Q" + topic + r"\E"]


def book_text(raw: Column, headers: list[str]) -> Column:
    """Without page numbers and running titles, glyph junk as spaces, white space collapsed."""
    lines = F.split(raw, "\n")
    bare = lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    kept = F.filter(lines, lambda line: ~(bare(line).rlike(r"\A\p{Nd}+\z") | bare(line).isin(*headers)))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), BOOK_JUNK, " "), r"(?U)\s+", " "))


def question_part(span: Column) -> Column:
    """The part of a problem before its solution, or before the separator, whichever comes first."""
    return F.regexp_replace(F.element_at(F.split(F.element_at(F.split(span, SOLUTION, 2), 1), SEPARATOR, 2), 1), r"(?U)^\s+|\s+$", "")


def restart_sections(rows: DataFrame, by: str, order: str, number: str, out: str = "section") -> DataFrame:
    """``rows`` with the section of each: a number not above the one before opens a new one."""
    ordered = Window.partitionBy(by).orderBy(order)
    before = F.lag(number).over(ordered)
    opened = rows.withColumn("_opens", F.when(before.isNull() | (F.col(number) <= before), 1).otherwise(0))
    return opened.withColumn(out, F.sum("_opens").over(ordered)).drop("_opens")


def section_ranges(toc: DataFrame, book: str = "book", ord_: str = "ord") -> DataFrame:
    """book, title, page, end, subsections of each level-2 bookmark; the last ends with its document (null)."""
    tops = toc.where("level <= 2")
    lead = F.lead("page").over(Window.partitionBy(book).orderBy(ord_))
    spans = tops.withColumns({"end": lead, "_until": F.lead(ord_).over(Window.partitionBy(book).orderBy(ord_))}).where("level = 2")
    subs = toc.where("level > 2").select(F.col(book).alias("_b"), F.col(ord_).alias("_o"), F.col("title").alias("_t"))
    joined = spans.join(subs, (spans[book] == subs["_b"]) & (subs["_o"] > spans[ord_]) & (spans["_until"].isNull() | (subs["_o"] < spans["_until"])), "left")
    grouped = joined.groupBy(book, ord_, "title", "page", "end").agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(F.col("_o").alias("o"), F.col("_t").alias("t"))))).alias("s"))
    return grouped.select(book, ord_, "title", "page", "end", F.transform("s", lambda x: x["t"]).alias("subsections"))


_YEAR = re.compile(r"(?:19|20)\d{2}")
_EXAM_YEAR = re.compile(r"(Prelim|Pelim|Promo)\s*((?:19|20)\d{2})")
_PAPER = re.compile(r"P\d|I{1,3}")
_FIELDS = ("year", "school", "level", "exam", "paper", "question_no")

#: Which field stands where, by the number of parts and the place of the year. ``*`` is exam and year in one part.
SHAPES = {
    (4, "exam-year first"): ("*", "school", "paper", "question_no"),
    (5, "year first"): ("year", "exam", "school", "paper", "question_no"),
    (4, "year first"): ("year", "school", "paper", "question_no"),
    (6, "year second"): ("school", "year", "exam", "level", "paper", "question_no"),
    (5, "year second"): ("school", "year", "exam", "paper", "question_no"),
    (4, "exam-year second"): ("school", "*", "paper", "question_no"),
    (4, "year second"): ("school", "year", "paper or exam", "question_no"),
}


def page_provenance(tag: str | None) -> dict:
    """The parts of a printed source reference; all null for a shape that is not known."""
    out: dict = dict.fromkeys(_FIELDS)
    if not tag:
        return out
    parts = [p.strip() for p in tag.split("/")]

    def put(field: str, value: str) -> None:
        if field == "*":
            exam = _EXAM_YEAR.fullmatch(value)
            out["exam"], out["year"] = exam[1], int(exam[2])
        elif field == "year":
            out["year"] = int(value)
        elif field == "question_no":
            out[field] = value[1:] if re.fullmatch(r"Q\d.*", value) else value
        elif field == "paper or exam":
            out["paper" if _PAPER.fullmatch(value) else "exam"] = value
        else:
            out[field] = value

    if len(parts) == 2 and " " in parts[0]:
        for token in parts[0].split():
            put("year" if _YEAR.fullmatch(token) else "exam" if token.lower() in ("prelim", "promo", "mye", "eoy") else "paper" if _PAPER.fullmatch(token) else "school", token)
        put("question_no", parts[1])
        return out
    tests = {"exam-year first": (0, _EXAM_YEAR), "year first": (0, _YEAR), "year second": (1, _YEAR), "exam-year second": (1, _EXAM_YEAR)}
    for (n, place), fields in SHAPES.items():
        at, pattern = tests[place]
        if len(parts) == n and pattern.fullmatch(parts[at]):
            for field, value in zip(fields, parts, strict=True):
                put(field, value)
            return out
    return out


@F.pandas_udf(TAG_FIELDS)
def parse_page_provenance(tag: pd.Series) -> pd.DataFrame:
    """:func:`page_provenance` over Arrow batches."""
    found = pd.DataFrame([page_provenance(t if isinstance(t, str) else None) for t in tag], columns=list(_FIELDS))
    found["year"] = found["year"].astype("Int32")
    return found


def problems(text: Column) -> Column:
    """How many ``Problem n.`` lines a text has."""
    return F.regexp_count(text, F.lit(PROBLEM))
