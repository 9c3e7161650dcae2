"""Files: JSON lines, LaTeX folders, ledgers, truth files, page lines; and the guarded sinks.

Listing and path checks run on the driver; contents are read by Spark.
"""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import latex
from ..functions import text as tx
from ..operators import corpus


class SourceError(ValueError):
    """A source that is not as it must be."""


# --- sources -------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.CORPUS) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, missing fields are null."""
    return spark.read.schema(schema).json(path)


def read_extractions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files in a fixed order, which must all exist, with ``ord`` by file and line."""
    missing = [p for p in paths if "://" not in p and not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(f"extractor output missing: {missing[0]}")
    out = None
    for rank, path in enumerate(paths):
        # A line's place is the offset of its block and its number there, which never reaches the next block's offset.
        rows = spark.read.schema(schemas.CORPUS).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
        number = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_at")) - 1
        part = rows.withColumn("ord", F.lit(rank << 52) + F.col("_start") + number).drop("_file", "_start", "_at")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _texts(spark: SparkSession, pattern: str) -> DataFrame:
    """path, name, folder, raw and ord of whole text files, which ascend by path."""
    found = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    parts = F.split("path", "/")
    # Partitions of the sorted files ascend, and so do the numbers within them.
    found = found.orderBy("path").withColumn("ord", F.monotonically_increasing_id())
    return found.withColumns({"name": F.element_at(parts, -1), "folder": F.element_at(parts, -2), "parent": F.element_at(parts, -3)})


def _required(rows: DataFrame, condition, message) -> DataFrame:
    """``rows``, failing on the first that does not meet the condition."""
    return rows.withColumn("_ok", F.when(condition, True).otherwise(F.raise_error(message).cast("boolean"))).where("_ok").drop("_ok")


def revision_packages(spark: SparkSession, root: str) -> DataFrame:
    r"""One question for each ``<chapter>/parts/*_q.tex``: exactly one ``\qend`` with its provenance; chapters must resolve."""
    files = corpus.resolve_labels(_texts(spark, f"{root}/*/parts/*_q.tex").drop("folder").withColumnRenamed("parent", "folder"), "folder")
    files = _required(files, F.col("chapter").isNotNull(), F.concat(F.lit("unrecognised chapter folder: "), "folder"))
    tags = F.regexp_extract_all("raw", F.lit(r"\\qend\{([^}]*)\}"), F.lit(1))
    files = _required(files.withColumn("tags", tags), F.size("tags") == 1, F.concat(F.lit("expected exactly one qend in "), "path"))
    read = files.withColumns({"prose": latex.to_prose("raw"), "p": latex.parse_provenance(F.get("tags", 0))})
    row_id = F.concat(F.lit("rp:"), "folder", F.lit(":"), F.regexp_replace("name", r"_q\.tex$", ""))
    return read.select(row_id.alias("id"), "ord", "chapter", "prose.text", F.col("raw").alias("raw_text"), F.lit("revision_package").alias("source"), "p.year", "p.school", "p.level", "p.exam", "p.paper", "p.question_no", "p.modified", tx.marks(F.col("raw")).alias("marks"), "path", "prose.dropped", "p.unparsed")


def tutorials(spark: SparkSession, root: str) -> DataFrame:
    r"""Every question of ``<chapter>/*.tex`` whose name does not say solutions, cut at ``\Q``."""
    files = corpus.resolve_labels(_texts(spark, f"{root}/*/*.tex").where(~F.lower("name").contains("solutions")), "folder")
    files = _required(files, F.col("chapter").isNotNull(), F.concat(F.lit("unrecognised chapter folder: "), "folder"))
    body = F.get(F.split("raw", r"\\begin\{document\}", 2), 1)
    chunks = files.select("folder", "chapter", "path", "ord", F.posexplode(latex.split_tutorial(body)).alias("at", "chunk"))
    read = chunks.withColumn("prose", latex.to_prose(tx.without_mark_counts(F.col("chunk"))))
    n = F.col("at") + 1
    row_id = F.concat(F.lit("tut:"), "folder", F.lit(":q"), F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")))
    return read.select(row_id.alias("id"), (F.shiftleft("ord", 16) + F.col("at")).alias("ord"), "chapter", "prose.text", F.col("chunk").alias("raw_text"), F.lit("tutorial_latex").alias("source"), F.lit(False).alias("modified"), tx.tutorial_marks(F.col("chunk")).alias("marks"), "path", "prose.dropped")


def read_ledger(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The records of a ledger, and (path, note) of those that cannot be read or have other fields than a record.

    Records span lines, so files are read whole; Spark's own JSON reader would pass over unknown fields.
    """
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    fields = [f.name for f in spark.createDataFrame([], schemas.RUN).schema]
    optional = {"fraction", "train_rows"}
    keys = F.json_object_keys("raw")
    known = F.array(*[F.lit(f) for f in fields])
    needed = F.array(*[F.lit(f) for f in fields if f not in optional])
    note = F.when(keys.isNull(), "not a JSON object").when(F.size(F.array_except(keys, known)) > 0, "unknown fields").when(F.size(F.array_except(needed, keys)) > 0, "missing fields")
    judged = files.withColumns({"note": note, "run": F.from_json("raw", schemas.RUN)}).withColumn("note", F.coalesce("note", F.when(F.col("run.approach").isNull(), "not a record")))
    good = judged.where("note is null").select("path", "run.*").withColumn("fraction", F.coalesce("fraction", F.lit(1.0)))
    return good, judged.where("note is not null").select("path", "note")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, number, start_page, pages, held_out of a truth file (a map of cases)."""
    text = spark.read.text(path, wholetext=True)
    cases = text.select(F.explode(F.from_json("value", schemas.TRUTH)).alias("paper_id", "case"))
    asked = cases.select("paper_id", "case.held_out", F.explode("case.questions").alias("q"))
    return asked.select("paper_id", F.col("q.n").alias("number"), F.array_min("q.pages").alias("start_page"), "q.pages", "held_out")


def safe_path(path: str) -> str:
    """A path of a truth file: neither absolute nor upwards."""
    if os.path.isabs(path) or ".." in Path(path).parts:
        raise SourceError(f"path leaves its folder: {path}")
    return path


def school_aliases(spark: SparkSession, path: str | None) -> DataFrame:
    """alias, school of a JSON map; no file, no aliases."""
    found = json.loads(Path(path).read_text()) if path and os.path.exists(path) else {}
    return spark.createDataFrame(list(found.items()), "alias string, school string")


def sorted_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``ord``: by page, height rounded half to even, then from the left; equal places keep their order."""
    order = Window.partitionBy("paper_id").orderBy("page", F.bround("y0", 0), "x0", "ord")
    return lines.withColumn("ord", F.row_number().over(order).cast("long") - 1)


def pdf_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Page lines of PDF files; needs a PDF library on the executors, which is imported there only."""
    from collections.abc import Iterator

    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for page in doc:
                        for block in page.get_text("dict")["blocks"]:
                            for line in block.get("lines", []):
                                spans = line["spans"]
                                x0, y0, x1, y1 = (round(v, 1) for v in line["bbox"])
                                rows.append((path, len(rows), page.number, page.rect.height, x0, y0, x1, y1, max((s["size"] for s in spans), default=None), "".join(s["text"] for s in spans)))
                yield pd.DataFrame(rows, columns=["paper_id", "ord", "page", "page_height", "x0", "y0", "x1", "y1", "size", "text"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return sorted_lines(files.mapInPandas(read, schemas.LINE))


def pdf_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """source (the folder), page from 0, text of PDF files; needs a PDF library on the executors, which is imported there only."""
    from collections.abc import Iterator

    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    yield pd.DataFrame([(path.split("/")[-2], page.number, page.get_text()) for page in doc], columns=["source", "page", "text"])

    files = spark.read.format("binaryFile").load(pattern).where(~F.col("path").contains("Sol")).select("path", "content")
    return files.mapInPandas(read, "source string, page int, text string")


def label_skeleton(found: DataFrame, pdf: str, label: str, pages: list[int]) -> dict:
    """The entry of a truth file to be checked by hand, from the questions (number, pages) that the reader found in one paper."""
    questions = [{"n": r.number, "pages": list(r.pages)} for r in found.orderBy("number").select("number", "pages").collect()]  # one paper
    return {label: {"pdf": safe_path(pdf), "label": label, "held_out": False, "pages": pages, "note": "", "questions": questions}}


def renumbered(truth: DataFrame, recipe: DataFrame) -> DataFrame:
    """``truth`` (paper_id, number, pages) of papers that were rebuilt from some of their pages: each page is its place in the recipe (paper_id, kept)."""
    joined = truth.join(recipe, "paper_id")
    place = F.transform("pages", lambda p: (F.array_position("kept", p) - 1).cast("int"))
    return joined.withColumn("pages", place).withColumn("start_page", F.array_min("pages")).drop("kept")


# --- sinks ---------------------------------------------------------------------------------


def inside(root: str, path: str) -> str:
    """The path, which must lie under the root."""
    full = os.path.realpath(path)
    if os.path.commonpath([os.path.realpath(root), full]) != os.path.realpath(root):
        raise SystemExit(f"refusing to write outside {root}: {path}")
    return full


def write_jsonl(rows: DataFrame, path: str, root: str | None = None) -> None:
    """JSON lines in the order of ``ord``, characters unescaped."""
    target = inside(root, path) if root else path
    (rows.orderBy("ord").drop("ord") if "ord" in rows.columns else rows).write.mode("overwrite").json(target)


def write_corpus(rows: DataFrame, path: str, side_path: str, root: str | None = None) -> None:
    """Labelled rows to one place, unlabelled ones to another, in order; nothing is written if an id is missing or repeated."""
    corpus.require_unique_ids(rows)
    labelled, unlabelled = corpus.labelled(rows)
    write_jsonl(labelled, path, root)
    write_jsonl(unlabelled, side_path, root)


def write_report(path: str, text: str, root: str | None = None) -> str:
    """A Markdown report in one step."""
    return write_atomically(inside(root, path) if root else path, text)


def write_split(rows: DataFrame, split: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """Check a split, then write it, one folder for each part; nothing is written if a check fails."""
    from ..operators import split as splitting

    splitting.check(rows, split, labels)
    split.drop("key").write.mode("overwrite").partitionBy("split").json(path)


def fraction_tag(fraction: float) -> str:
    """How a fraction stands in a file name; the whole has none."""
    return "" if abs(fraction - 1.0) < 1e-9 else f"-f{round(fraction * 100):03d}"


def record_run(folder: str, run: dict) -> str:
    """Write a record under the name of its key, in place of an older one of the same key."""
    name = f"{run['approach']}-seed{run['seed']}{fraction_tag(run.get('fraction', 1.0))}-{run['test_hash']}.json"
    return write_atomically(os.path.join(folder, name), json.dumps(run, ensure_ascii=False, indent=1))


def write_atomically(path: str, text: str) -> str:
    """Write a small file on the driver so that readers see the old one or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as out:
        out.write(text)
    os.replace(out.name, path)
    return path


def write_policy(path: str, policy: dict, model_sha256: str, root: str) -> str:
    """Write a runtime policy outside the project, unless one of another model is in its place."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([base, real]) == base:
        raise SourceError("a policy belongs outside the project")
    if os.path.exists(path) and json.loads(Path(path).read_text()).get("model_sha256") != model_sha256:
        raise SourceError("a policy of another model is in its place")
    return write_atomically(path, json.dumps(policy, indent=1))
