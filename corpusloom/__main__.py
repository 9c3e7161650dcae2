"""The command line: ``python -m corpusloom COMMAND ...``.

    classify [--min-confidence X] [--top N] [QUESTION]   one question, or standard input
    paper [--min-confidence X] [--pages 1-5,8] FILE.pdf   every question of a paper
    score TRUTH.json QUESTIONS.jsonl                       found, exact and spurious questions
    label FILE.pdf NAME [--pages 1-5,8]                    a truth entry to be checked by hand
    policy CUTOFF TARGET                                   write the runtime policy of the model
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import dims, schemas
from .config import Config
from .functions import text as tx
from .ml import model
from .operators import metrics, reader, reports, service
from .session import session
from .sources import files


def _model(config: Config) -> model.ChapterModel:
    if config.model_path is None:
        raise SystemExit("CORPUSLOOM_MODEL_PATH names no model")
    return model.ChapterModel.load(config.model_path)


def _say(ranked: list[tuple[str, float]], cutoff: float) -> None:
    name, best = dims.CHAPTERS.get(ranked[0][0], ranked[0][0]), ranked[0][1]
    if best < cutoff:
        print(reports.decline_line(name, best, cutoff))
    for slug, p in ranked:
        print(f"  {reports.pct(p):>6}  {dims.CHAPTERS.get(slug, slug)}")


def _pages(lines, spec: str | None):
    wanted = reader.parse_pages(spec)
    lines = lines if wanted is None else lines.where(F.col("page").isin(wanted))
    return lines, lines.select("paper_id", "page").distinct()


def classify(args, spark, config: Config) -> None:
    question = args.question if args.question is not None else sys.stdin.read()
    if not question.strip():
        raise SystemExit("there is no question")
    row = spark.createDataFrame([(0, question)], "id long, text string").withColumn("text", tx.normalise_question("text"))
    found = _model(config).rank(row, "id", args.top).orderBy("rank").collect()
    _say([(r.chapter, r.probability) for r in found], args.min_confidence)


def paper(args, spark, config: Config) -> None:
    lines, pages = _pages(files.pdf_lines(spark, service.readable_paper(args.file)), args.pages)
    found = service.classify_paper(_model(config), lines, pages, args.top, args.min_confidence).orderBy("number", "rank").collect()
    for number in dict.fromkeys(r.number for r in found):
        own = [r for r in found if r.number == number]
        print(f"question {number}, pages {', '.join(str(p + 1) for p in own[0].pages)}")
        _say([(r.chapter, r.probability) for r in own], args.min_confidence)


def score(args, spark, config: Config) -> None:
    guess = spark.read.schema(schemas.QUESTION).json(args.questions).withColumn("ord", F.monotonically_increasing_id())
    row = metrics.truth_score(files.read_truth(spark, args.truth), guess).first()
    print(f"found {row.found} of {row.wanted}, exact pages {row.exact}, spurious {row.spurious}")


def label(args, spark, config: Config) -> None:
    lines, pages = _pages(files.pdf_lines(spark, service.readable_paper(args.file)), args.pages)
    found, _ = reader.read_papers(lines, pages, strict=False)
    print(json.dumps(files.label_skeleton(found, args.file, args.name, reader.parse_pages(args.pages) or []), indent=2))


def policy(args, spark, config: Config) -> None:
    if config.model_path is None:
        raise SystemExit("CORPUSLOOM_MODEL_PATH names no model")
    digest = service.folder_sha256(config.model_path)
    files.write_policy(args.target, service.make_policy(args.cutoff, digest, args.validation_sha256), digest, args.project)


def _confidence(value: str) -> float:
    return reports.min_confidence(["--min-confidence", value])[0]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    for run, own in ((classify, [("question", {"nargs": "?"})]), (paper, [("file", {}), ("--pages", {})]), (score, [("truth", {}), ("questions", {})]), (label, [("file", {}), ("name", {}), ("--pages", {})]), (policy, [("cutoff", {"type": float}), ("target", {}), ("--validation-sha256", {"required": True}), ("--project", {"default": "."})])):
        command = commands.add_parser(run.__name__)
        command.set_defaults(run=run)
        for name, settings in own:
            command.add_argument(name, **settings)
        if run in (classify, paper):
            command.add_argument("--min-confidence", type=_confidence, default=0.0)
            command.add_argument("--top", type=int, default=3)
    return out


def main(argv: list[str] | None = None, spark=None, config: Config | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args, spark or session(master="local[*]"), config or Config.read())


if __name__ == "__main__":
    main()
