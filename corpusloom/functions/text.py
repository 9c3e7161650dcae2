"""String normalisation and provenance, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _falsy(column: Column) -> Column:
    return column.isNull() | (column == "")


def normalise_question(text: Column | str) -> Column:
    """White space of any kind becomes one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(_text(text), r"(?U)\s+", " "))


def comparable_text(text: Column | str) -> Column:
    """Lower-cased ASCII letters and digits, all else one space."""
    return F.trim(F.regexp_replace(F.lower(_text(text)), "[^a-z0-9]+", " "))


def normalise_paper(paper: Column) -> Column:
    """P1, P2 or P3 for the spellings of a paper; others upper-cased without spaces; null and empty give null."""
    compact = F.replace(F.upper(F.trim(paper)), F.lit(" "), F.lit(""))
    folded = F.when(compact.isin("I", "1"), "P1").when(compact.isin("II", "2"), "P2").when(compact == "III", "P3").otherwise(compact)
    return F.when(~_falsy(paper), folded)


_NUMBER = r"^\s*q?\s*(\d+)\s*\(?\s*([a-z])?"


def normalise_question_number(number: Column) -> Column:
    """The digits and the letter after them; what has no digits is trimmed and lower-cased."""
    low = F.lower(number)
    found = F.concat(F.regexp_extract(low, _NUMBER, 1), F.regexp_extract(low, _NUMBER, 2))
    return F.when(~_falsy(number), F.when(low.rlike(_NUMBER), found).otherwise(F.trim(low)))


def provenance_identity(school: Column, year: Column, paper: Column, number: Column) -> Column:
    """A struct of all four parts, or null if any is missing."""
    parts = {
        "school": F.when(~_falsy(school), F.replace(F.upper(F.trim(school)), F.lit(" "), F.lit(""))),
        "year": F.when(year != 0, year),
        "paper": normalise_paper(paper),
        "question": normalise_question_number(number),
    }
    complete = parts["school"].isNotNull() & (parts["school"] != "")
    for part in ("year", "paper", "question"):
        complete = complete & parts[part].isNotNull()
    complete = complete & (parts["paper"] != "") & (parts["question"] != "")
    return F.when(complete, F.struct(*[v.alias(k) for k, v in parts.items()]))


def leakage_group_key(school: Column, year: Column, paper: Column, source_file: Column, row_id: Column) -> Column:
    """One paper is one group; else one file; else the id up to its last colon; else the row.

    A school that is the empty string still makes a paper key, and the school is taken as written.
    """
    none = F.lit(None).cast("string")

    def key(kind: str, ref: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), none.alias("school"), F.lit(None).cast("int").alias("year"), none.alias("paper"), ref.alias("ref"))

    of_paper = F.struct(F.lit("paper").alias("kind"), school.alias("school"), year.cast("int").alias("year"), normalise_paper(paper).alias("paper"), none.alias("ref"))
    own_id = F.coalesce(row_id, F.lit(""))
    container = F.regexp_replace(own_id, ":[^:]*$", "")
    return F.when(school.isNotNull() | year.isNotNull(), of_paper).when(~_falsy(source_file), key("file", source_file)).when(own_id.contains(":"), key("file", container)).otherwise(key("row", own_id))


def grouping_hint(source: Column, row_id: Column) -> Column:
    """The part of the id that names the file of a tutorial; else the id."""
    return F.when(source == "tutorial_latex", F.substring_index(row_id, ":", 2)).when(source == "tutorial_pdf", F.regexp_replace(row_id, "-[^-]*$", "")).otherwise(row_id)


def strip_comments(latex: Column) -> Column:
    """Without ``%`` comments; an escaped ``\\%`` stays."""
    return F.regexp_replace(latex, r"(?<!\\)%.*", "")


def marks(latex: Column) -> Column:
    r"""The sum of all ``\mk{n}``; null if there is none."""
    found = F.regexp_extract_all(latex, F.lit(r"\\mk\{(\d+)\}"), F.lit(1))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int")))


def tutorial_marks(latex: Column) -> Column:
    r"""The number of ``\qend{n}``, else of a closing ``\textbf{[n]}``; null if there is neither."""
    end, bold = F.regexp_extract(latex, r"\\qend\{(\d+)\}", 1), F.regexp_extract(latex, r"\\textbf\{\[(\d+)\]\}(?:\s|\\end\{minipage\})*$", 1)
    return F.when(end != "", end.cast("int")).when(bold != "", bold.cast("int"))


def without_mark_counts(latex: Column) -> Column:
    r"""Without ``\hfill\textbf{[n]}``, so that a mark count does not leak into the text."""
    return F.regexp_replace(latex, r"\\hfill\\textbf\{\[\d+\]\}", " ")


def is_solution_page(text: Column) -> Column:
    """More than three U+0003 characters."""
    return F.length(text) - F.length(F.replace(text, F.lit("\x03"), F.lit(""))) > 3


# The patterns of question markers, provenance tags, answer headings.
QUESTION_MARK = r"(?m)^\s*Q(\d+)\.(.*)$"
PROVENANCE_LINE = r"\[\s*((?:[A-Z]{1,6}(?:\(JC\))?/)?(?:(?:Prelim|Pelim|Promo)\s*)?(?:19|20)\d{2}[ /][^\[\]]{0,55})\]"
PROVENANCE_TAG = rf"(?m)^\s*{PROVENANCE_LINE}\s*$"
ANSWER_HEADING = r"(?m)^\s*(Level\s*[123]|Answers?)\s*$"


def is_answer_key_page(text: Column) -> Column:
    """An answer heading without any question marker or provenance tag."""
    return ~text.rlike(QUESTION_MARK) & ~text.rlike(PROVENANCE_TAG) & text.rlike(ANSWER_HEADING)


def first_provenance(text: Column) -> Column:
    """The first provenance tag of the text; null if there is none."""
    found = F.trim(F.regexp_extract(text, PROVENANCE_TAG, 1))
    return F.when(found != "", found)


def problem_id(subsection: Column, number: Column) -> Column:
    """``book-<slug>-p<nn>`` without its source's prefix: the slug and the two-digit number."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(subsection), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("triplemath-"), slug, F.lit("-p"), F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))


def subsection_kind(title: Column) -> Column:
    """The first word of a subsection title, which must be one of three."""
    first = F.substring_index(F.trim(title), " ", 1)
    return F.when(first.isin("Tutorial", "Self-Practice", "Assignment"), first).otherwise(F.raise_error(F.concat(F.lit("unrecognised subsection: "), title)).cast("string"))


def token_count(text: Column) -> Column:
    """White-space tokens: the stand-in for a model's tokenizer."""
    clean = normalise_question(text)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))
