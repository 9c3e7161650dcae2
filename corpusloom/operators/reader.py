"""Cutting papers into questions, from page lines.

A paper is the unit of parallelism: every step groups or windows by ``paper_id``, whose lines are
bounded by one printed paper. Lines come in reading order, ``ord``; their unit (points or pixels)
is one per paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables

# Fixed values of the page geometry.
FOOTER, SMALLEST_BODY, CUT_BAND, TOP_OF_PAGE, PAGE_HEIGHT = 0.92, 6.5, 6.0, 0.12, 842.0
TEXT_TOP, TEXT_TOLERANCE, OCR_TOP, OCR_TOLERANCE = 50.0, 2.0, 0.06, 8.0
FEW_CHARACTERS, SCANNED_SHARE, MOST_PAGES = 40, 0.5, 4
DOTS = r"\.{15,}"
MARKER = r"(?s)^(\d{1,2})(?:[.)]\s*|\s+|$)(.*)$"
STOP_LINE = r"(?i)^(Section\s+[A-Z]\b|BLANK PAGE|Additional page|Permission to reproduce items)"


class PaperReadError(RuntimeError):
    """A paper that could not be cut into questions to stand behind; carries its report."""

    def __init__(self, message: str, report: dict):
        super().__init__(message)
        self.report = report


def stripped(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)^\s+|\s+$", "")


def repeated_texts(lines: DataFrame, page_counts: DataFrame) -> DataFrame:
    """paper_id, text, pages: texts of five characters or more on at least half of a paper's pages, and on two."""
    per = lines.select("paper_id", stripped("text").alias("text"), "page").groupBy("paper_id", "text").agg(F.count_distinct("page").alias("pages"))
    found = per.join(page_counts, "paper_id")
    return found.where((F.length("text") >= 5) & (F.col("pages") >= F.greatest(F.lit(2.0), 0.5 * F.col("page_count")))).select("paper_id", "text", "pages")


def with_furniture(lines: DataFrame, page_counts: DataFrame, top_margin: Column | float = TEXT_TOP) -> DataFrame:
    """``lines`` with ``body``, the stripped text, and ``furniture``: printed by the page, not by a question."""
    top = top_margin if isinstance(top_margin, Column) else F.lit(float(top_margin))
    repeated = repeated_texts(lines, page_counts).select("paper_id", F.col("text").alias("body"), F.lit(True).alias("repeated"))
    joined = lines.withColumn("body", stripped("text")).join(repeated, ["paper_id", "body"], "left")
    rule = (F.col("body") == "") | F.coalesce(F.col("size") < SMALLEST_BODY, F.lit(False)) | F.col("body").rlike(DOTS) | (F.col("y0") < top) | (F.col("y0") > F.col("page_height") * FOOTER) | F.coalesce("repeated", F.lit(False))
    return joined.withColumn("furniture", rule).drop("repeated")


def question_column(body: DataFrame) -> DataFrame:
    """paper_id, column: the smallest x0 that three lines share."""
    return body.groupBy("paper_id", "x0").agg(F.count("*").alias("n")).where("n >= 3").groupBy("paper_id").agg(F.min("x0").alias("column"))


def skewed_column(body: DataFrame, tolerance: float = OCR_TOLERANCE) -> DataFrame:
    """paper_id, slope, intercept: the least-squares left edge of a scanned page; level where fewer than three lines lie in the band."""
    left = body.groupBy("paper_id").agg(F.min("x0").alias("left"))
    band = body.join(left, "paper_id").where(F.col("x0") <= F.col("left") + 4 * tolerance)
    fit = band.groupBy("paper_id").agg(F.count("*").alias("n"), F.regr_slope("x0", "y0").alias("s"), F.avg("x0").alias("mx"), F.avg("y0").alias("my"))
    joined = fit.join(question_column(body), "paper_id", "left")
    slope = F.when(F.col("n") >= 3, F.coalesce(F.when(~F.isnan("s"), F.col("s")), F.lit(0.0))).otherwise(0.0)
    return joined.select("paper_id", slope.alias("slope"), F.when(F.col("n") >= 3, F.col("mx") - slope * F.col("my")).otherwise(F.col("column")).alias("intercept"))


def ascending(lines: Column) -> Column:
    """Of ordered structs with a number ``n``: those that carry on 1, 2, 3 ... (99 at most, as numbers have two digits)."""
    start = F.struct(F.lit(1).alias("next"), F.filter(lines, lambda _: F.lit(False)).alias("kept"))
    taken = lambda a, x: F.struct((a["next"] + 1).alias("next"), F.concat(a["kept"], F.array(x)).alias("kept"))
    return F.aggregate(lines, start, lambda a, x: F.when(x["n"] == a["next"], taken(a, x)).otherwise(a), lambda a: a["kept"])


def find_markers(body: DataFrame, columns: DataFrame, tolerance: float = TEXT_TOLERANCE) -> DataFrame:
    """paper_id, pos, ord, page, y0, rest: the lines in the column that carry on the numbers 1, 2, 3 ...

    ``columns`` is paper_id, slope, intercept. The numbers are taken in one fold over the paper's candidate lines.
    """
    near = F.abs(F.col("x0") - (F.col("slope") * F.col("y0") + F.col("intercept"))) <= tolerance
    lines = body.join(columns, "paper_id").where(near & ~F.col("body").rlike(STOP_LINE) & F.col("body").rlike(MARKER))
    numbered = lines.select("paper_id", F.struct("ord", F.regexp_extract("body", MARKER, 1).cast("int").alias("n"), "page", "y0", stripped(F.regexp_extract("body", MARKER, 2)).alias("rest")).alias("line"))
    ordered = numbered.groupBy("paper_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return ordered.select("paper_id", F.explode(ascending(F.col("lines"))).alias("m")).select("paper_id", F.col("m.n").alias("pos"), "m.ord", "m.page", "m.y0", "m.rest")


def cut_points(markers: DataFrame, body: DataFrame) -> DataFrame:
    """``markers`` with cut_y: 0 for the first marker of a page near its top, else a band above the marker."""
    heights = body.groupBy("paper_id", "page").agg(F.min_by("page_height", "ord").alias("height"))
    first = F.row_number().over(Window.partitionBy("paper_id", "page").orderBy("pos")) == 1
    joined = markers.withColumn("_first", first).join(heights, ["paper_id", "page"], "left")
    top = F.col("y0") < F.coalesce("height", F.lit(PAGE_HEIGHT)) * TOP_OF_PAGE
    return joined.withColumn("cut_y", F.when(F.col("_first") & top, 0.0).otherwise(F.col("y0") - CUT_BAND)).drop("_first", "height")


def owners(body: DataFrame, cuts: DataFrame) -> DataFrame:
    """``body`` with the marker (pos, marker_ord, marker_page, marker_y) that owns each line: the last whose cut is not below it; and the last stop line not below it.

    Lines and cuts of a paper are sorted together, once; the greatest position so far is the owner.
    """
    none = lambda t: F.lit(None).cast(t)
    line = body.select("paper_id", F.col("page").alias("_p"), F.col("y0").cast("double").alias("_y"), F.lit(1).alias("_k"), none("int").alias("_pos"), none("struct<ord:bigint,page:int,y0:double>").alias("_m"), F.struct(*body.columns).alias("_line"))
    cut = cuts.select("paper_id", F.col("page").alias("_p"), F.col("cut_y").alias("_y"), F.lit(0).alias("_k"), F.col("pos").cast("int").alias("_pos"), F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("page").cast("int").alias("page"), F.col("y0").cast("double").alias("y0")).alias("_m"), none(line.schema["_line"].dataType.simpleString()).alias("_line"))
    order = Window.partitionBy("paper_id").orderBy("_p", "_y", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = line.unionByName(cut).withColumn("_owner", F.max(F.struct(F.col("_pos").alias("pos"), F.col("_m").alias("m"))).over(order))
    # Of the stops not below a line, the greatest decides: it lies after the marker if any does. Equal places count.
    stop = F.when(F.col("_line.body").rlike(STOP_LINE), F.struct(F.col("_p").alias("p"), F.col("_y").alias("y")))
    both = both.withColumn("_stop", F.max(stop).over(Window.partitionBy("paper_id").orderBy("_p", "_y")))
    return both.where("_line is not null and _owner.pos is not null").select("_line.*", F.col("_owner.pos").alias("pos"), F.col("_owner.m.ord").alias("marker_ord"), F.col("_owner.m.page").alias("marker_page"), F.col("_owner.m.y0").alias("marker_y"), F.col("_stop").alias("last_stop"))


def before_stops(owned: DataFrame) -> DataFrame:
    """Without stop lines, marker lines, and lines past a stop line that follows their marker."""
    stop, page, y = F.col("last_stop"), F.col("marker_page"), F.col("marker_y")
    past = F.coalesce((stop["p"] > page) | ((stop["p"] == page) & (stop["y"] > y)), F.lit(False))
    return owned.where(~past & (F.col("ord") != F.col("marker_ord")) & ~F.col("body").rlike(STOP_LINE)).drop("last_stop")


def questions(markers: DataFrame, kept: DataFrame) -> DataFrame:
    """paper_id, number, start_page, pages, text of every marker."""
    lines = kept.select("paper_id", "pos", "page", F.struct("ord", "body").alias("line"))
    own = markers.select("paper_id", "pos", "page", F.struct(F.lit(-1).cast("long").alias("ord"), F.col("rest").alias("body")).alias("line"))
    grouped = lines.unionByName(own).groupBy("paper_id", "pos").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_list("line")).alias("lines"))
    text = F.array_join(F.filter(F.transform("lines", lambda x: x["body"]), lambda x: x != ""), " ")
    return grouped.join(markers.select("paper_id", "pos", F.col("page").alias("start_page")), ["paper_id", "pos"]).select("paper_id", F.col("pos").alias("number"), "start_page", "pages", text.alias("text"))


def segment(lines: DataFrame, page_counts: DataFrame, top_margin: Column | float = TEXT_TOP, tolerance: float = TEXT_TOLERANCE, skew: bool = False) -> tuple[DataFrame, DataFrame]:
    """The questions of every paper, and its column (paper_id, slope, intercept). The body lines are written once, as five steps read them."""
    body = tables.written(with_furniture(lines, page_counts, top_margin).where("not furniture").select("paper_id", "ord", "page", "page_height", "x0", "y0", "body"), "body")
    columns = skewed_column(body, tolerance) if skew else question_column(body).select("paper_id", F.lit(0.0).alias("slope"), F.col("column").alias("intercept"))
    markers = find_markers(body, columns, tolerance)
    kept = before_stops(owners(body, cut_points(markers, body)))
    return questions(markers, kept), columns


def character_counts(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, page, chars of every page of ``pages``, those without lines too."""
    sums = lines.groupBy("paper_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    return pages.select("paper_id", "page").distinct().join(sums, ["paper_id", "page"], "left").select("paper_id", "page", F.coalesce("chars", F.lit(0)).alias("chars"))


def rungs(counts: DataFrame) -> DataFrame:
    """paper_id, rung, scanned: 2 (read by OCR) where more than half of the pages hold under 40 characters."""
    few = F.col("chars") < FEW_CHARACTERS
    found = counts.groupBy("paper_id").agg(F.count_if(few).alias("k"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(few, F.col("page")))).alias("scanned"), F.array_sort(F.collect_set("page")).alias("pages_read"))
    return found.select("paper_id", F.when(F.col("k") > SCANNED_SHARE * F.col("n"), 2).otherwise(1).alias("rung"), "scanned", "pages_read")


def reports(found: DataFrame, rung: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """One report for each paper of ``rung``: gaps, repeats, spans and empty questions, and whether it can be trusted."""
    sums = found.groupBy("paper_id").agg(
        F.count("*").alias("questions"),
        F.max("number").alias("highest_number"),
        F.array_sort(F.collect_list("number")).alias("numbers"),
        F.array_sort(F.collect_list(F.when(F.size("pages") > MOST_PAGES, F.struct("number", "pages")))).alias("oversized_questions"),
        F.array_sort(F.collect_list(F.when(stripped("text") == "", F.col("number")))).alias("empty_questions"),
    )
    joined = rung.join(sums, "paper_id", "left")
    if columns is not None:
        joined = joined.join(columns.select("paper_id", F.col("intercept").alias("question_column"), F.col("slope").alias("column_slope")), "paper_id", "left")
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    full = joined.withColumns({
        "questions": F.coalesce("questions", F.lit(0)).cast("int"),
        "highest_number": F.coalesce("highest_number", F.lit(0)),
        "missing_numbers": F.when(F.coalesce("highest_number", F.lit(0)) > 0, F.array_except(F.sequence(F.lit(1), F.col("highest_number")), numbers)).otherwise(F.array().cast("array<int>")),
        "duplicated_numbers": F.array_distinct(F.filter(numbers, lambda x: F.size(F.filter(numbers, lambda y: y == x)) > 1)),
        "oversized_questions": F.coalesce("oversized_questions", F.array().cast("array<struct<number:int,pages:array<int>>>")),
        "empty_questions": F.coalesce("empty_questions", F.array().cast("array<int>")),
    })
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    # The words "no questions found" and "sequence incomplete".
    problems = F.concat(
        F.when(F.col("questions") == 0, F.array(F.lit("no questions found"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("missing_numbers") > 0, F.array(F.concat(F.lit("sequence incomplete: 1.."), F.col("highest_number").cast("string"), F.lit(" is missing "), listed("missing_numbers")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("duplicated_numbers") > 0, F.array(F.concat(F.lit("numbers given more than once: "), listed("duplicated_numbers")))).otherwise(F.array().cast("array<string>")),
        F.transform("oversized_questions", lambda q: F.concat(F.lit("question "), q["number"].cast("string"), F.lit(" spans "), F.size(q["pages"]).cast("string"), F.lit(" pages "), listed(q["pages"]), F.lit(f", where {MOST_PAGES} are the most"))),
        F.when(F.size("empty_questions") > 0, F.array(F.concat(F.lit("nothing to read in questions "), listed("empty_questions")))).otherwise(F.array().cast("array<string>")),
    )
    return full.withColumn("problems", problems).withColumn("trustworthy", F.size("problems") == 0).withColumnRenamed("scanned", "pages_without_text_layer").drop("numbers")


def read_papers(lines: DataFrame, pages: DataFrame, rung: int | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Questions and reports of all papers in ``pages`` (paper_id, page).

    Papers read by the text layer and papers read by OCR differ in margin, tolerance and the fit of
    their column. With ``strict`` one doubtful paper is an error; without, semi-join the questions
    with the trustworthy reports.
    """
    chosen = rungs(character_counts(lines, pages))
    if rung is not None:
        if rung not in (1, 2):
            raise ValueError(f"there is no rung {rung}; the rungs are 1 and 2")
        chosen = chosen.withColumn("rung", F.lit(rung))
    counts = pages.groupBy("paper_id").agg(F.count_distinct("page").alias("page_count"))
    of = lambda n: lines.join(chosen.where(F.col("rung") == n), "paper_id", "left_semi")
    typed, columns = segment(of(1), counts, TEXT_TOP, TEXT_TOLERANCE, False)
    raster = of(2).withColumn("_top", OCR_TOP * F.max("page_height").over(Window.partitionBy("paper_id")))
    scanned, slopes = segment(raster, counts, F.col("_top"), OCR_TOLERANCE, True)
    found = typed.unionByName(scanned)
    report = reports(found, chosen, columns.unionByName(slopes))
    if strict:
        bad = report.where("not trustworthy").limit(1).collect()
        if bad:
            raise PaperReadError(f"{bad[0].paper_id}: refusing a paper that is not to be trusted - {'; '.join(bad[0].problems)}", bad[0].asDict(recursive=True))
    return found, report


def parse_pages(spec: str | None) -> list[int] | None:
    """``0-4,7`` as page indices, from 0 as pages are counted; nothing gives null, which is all pages."""
    if not spec:
        return None
    bounds = [[int(x) for x in part.strip().split("-", 1)] for part in spec.split(",")]
    return [page for b in bounds for page in range(b[0], b[-1] + 1)]
