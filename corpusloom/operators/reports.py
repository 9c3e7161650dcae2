"""Markdown of small results, on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the mean gap below which confidences are said to be calibrated.
CALIBRATED = 0.05


def pct(x: float) -> str:
    return f"{x:.1%}"


def points(x: float, signed: bool = False) -> str:
    return f"{x * 100:+.1f} points" if signed else f"{x * 100:.1f} points"


def duration(seconds: float) -> str:
    minutes, rest = divmod(round(seconds), 60)
    return f"{seconds:.1f} s" if seconds < 60 else f"{minutes} min {rest} s"


def seed_list(seeds: list[int]) -> str:
    names = [str(s) for s in seeds]
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} and {names[-1]}"


def table(rows: DataFrame, headings: dict[str, str], order: str | None = None, formats: dict | None = None) -> str:
    """A Markdown table of the named columns of a small frame; nulls are dashes."""
    formats = formats or {}
    found = (rows.orderBy(order) if order else rows).select(*headings).collect()
    show = lambda c, v: "-" if v is None else formats.get(c, str)(v)
    lines = ["| " + " | ".join(headings.values()) + " |", "|" + "---|" * len(headings)]
    return "\n".join([*lines, *("| " + " | ".join(show(c, r[c]) for c in headings) + " |" for r in found)])


def sweep_table(points_: DataFrame) -> str:
    return table(points_, {"threshold": "Cutoff", "answered": "Answered", "coverage": "Coverage", "selective_accuracy": "Accuracy of answered", "full_accuracy": "Accuracy of all"}, "threshold", {"threshold": "{:.2f}".format, "coverage": pct, "selective_accuracy": pct, "full_accuracy": pct})


def reliability_table(bins: DataFrame) -> str:
    return table(bins, {"lower": "From", "upper": "To", "n": "Questions", "mean_confidence": "Mean confidence", "accuracy": "Accuracy"}, "lower", {"lower": "{:.1f}".format, "upper": "{:.1f}".format, "mean_confidence": pct, "accuracy": pct})


def decline_line(name: str, confidence: float, cutoff: float) -> str:
    """What is said before the candidates of a question that is not answered."""
    return f"not answered: the best guess, {name}, has {confidence:.1%}, under the cutoff of {cutoff:.0%}. Candidates:"


def trade_sentence(cutoff: float, declined: int, total: int, base: float, selective: float | None, full: float) -> str:
    """What a cutoff costs and buys."""
    if not declined:
        return f"At a cutoff of {cutoff:.2f} every question is answered, at {base:.1%}."
    return f"At a cutoff of {cutoff:.2f}, {declined} of {total} questions are declined; the accuracy of those answered goes from {base:.1%} to {selective:.1%}, and {full:.1%} of all are answered correctly."


def calibration_sentence(mean_gap: float, signed_gap: float, tolerance: float = CALIBRATED) -> str:
    """Whether confidences mean what they say."""
    if mean_gap < tolerance:
        return f"Confidence matches accuracy: the mean gap over the bins is {mean_gap * 100:.1f} points."
    side = "understating" if signed_gap < 0 else "overstating"
    return f"Confidence does not match accuracy: the mean gap over the bins is {mean_gap * 100:.1f} points, mostly {side} it."


def cost_sentence(one: dict, two: dict) -> str:
    """Which of two approaches (name, train_seconds, parameters) is cheaper, and by how much."""
    cheap, dear = sorted((one, two), key=lambda x: x["train_seconds"])
    small, big = sorted((one, two), key=lambda x: x["parameters"])
    return f"{cheap['name']} trains in {duration(cheap['train_seconds'])}, {dear['name']} in {duration(dear['train_seconds'])}, {dear['train_seconds'] / cheap['train_seconds']:,.0f} times as long; {small['name']} has {big['parameters'] / small['parameters']:,.0f} times fewer parameters."


def min_confidence(argv: list[str]) -> tuple[float, list[str]]:
    """``--min-confidence x`` of a command line, and the other arguments. Missing, negative and non-numbers are refused."""
    if "--min-confidence" not in argv:
        return 0.0, list(argv)
    at = argv.index("--min-confidence")
    try:
        value = float(argv[at + 1])
    except (IndexError, ValueError):
        raise ValueError("--min-confidence needs a number") from None
    if math.isnan(value) or value < 0:
        raise ValueError(f"--min-confidence must be 0 or more, got {value}")
    return value, argv[:at] + argv[at + 2 :]


# --- sections: each takes small frames or dictionaries and gives Markdown -------------------


def interval_text(low: float, high: float) -> str:
    return f"{pct(low)} to {pct(high)}"


def headline_section(summaries: DataFrame) -> str:
    """Accuracy of every approach: a row of :func:`ledger.summary` each."""
    shown = table(summaries, {"approach": "Approach", "runs": "Runs", "mean": "Mean accuracy", "stdev": "Deviation", "wilson_low": "Interval from", "wilson_high": "to"}, "approach", {"mean": pct, "stdev": points, "wilson_low": pct, "wilson_high": pct})
    return f"## Accuracy on the sealed test rows\n\n{shown}\n"


def seeds_sentence(coverage: DataFrame) -> str:
    """Which seeds each point was run with: rows of :func:`ledger.seed_coverage`."""
    found = coverage.orderBy("approach", "fraction").collect()
    return "; ".join(f"{r.approach} at {r.fraction:.0%}: seeds {seed_list(list(r.seeds))}" for r in found) + "."


def paired_table(pairs: DataFrame, by: str = "seed") -> str:
    """Rows of :func:`ledger.paired`: the four counts, the difference and the exact p."""
    return table(pairs, {by: by.capitalize(), "both": "Both right", "only_a": "Only first", "only_b": "Only second", "neither": "Neither", "difference": "Difference", "p": "p"}, by, {"difference": lambda x: points(x, signed=True), "p": "{:.2f}".format})


#: What a verdict of :func:`ledger.verdict` says.
VERDICTS = {
    "distinguishable": "The two approaches can be told apart: every paired test is significant, and the same side leads each time.",
    "indistinguishable": "The two approaches cannot be told apart: no paired test is significant.",
    "mixed": "The paired tests do not agree with each other.",
}
#: What a shape of :func:`ledger.shape` says.
SHAPES = {
    "incomplete": "The shape cannot be told yet: it needs two points with the same seeds.",
    "flat": "The curve is flat: its whole gain is negligible.",
    "flattened": "The curve has flattened: no test of its last step is significant.",
    "climbing": "The curve still climbs: every test of its last step is significant, with more data ahead.",
    "falling": "The curve falls at its last point: every test is significant, with less data ahead.",
    "mixed": "The tests of the last step do not agree with each other.",
}


def comparison_section(first: str, second: str, pairs: DataFrame, verdict: str) -> str:
    return f"## {first} against {second}\n\n{paired_table(pairs)}\n\n{VERDICTS[verdict]}\n"


def resplit_section(found: list[tuple[int, int]]) -> str:
    """(right, rows) of every fresh split."""
    shares = [k / n for k, n in found]
    mean = sum(shares) / len(shares)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in shares) / (len(shares) - 1)) if len(shares) > 1 else 0.0
    return f"## Fresh splits\n\nOver {len(shares)} fresh splits the mean accuracy is {pct(mean)} ({interval_text(min(shares), max(shares))}), with a deviation of {points(deviation)}.\n"


def curve_section(approach: str, points_: DataFrame, shape: str, pairs: DataFrame | None = None) -> str:
    """A learning curve: rows (fraction, train_rows, mean, step), its shape, and the last step seed by seed."""
    shown = table(points_, {"fraction": "Share", "train_rows": "Rows", "mean": "Mean accuracy", "step": "Step"}, "fraction", {"fraction": "{:.0%}".format, "train_rows": "{:.0f}".format, "mean": pct, "step": lambda x: points(x, signed=True)})
    last = f"\n\n{paired_table(pairs)}" if pairs is not None else ""
    return f"## {approach}\n\n{shown}{last}\n\n{SHAPES[shape]}\n"


def curves_sentence(result: str) -> str:
    """What :func:`ledger.curves_differ` found."""
    if result == "incomplete":
        return "The two curves cannot be compared: not all of their points have the same seeds."
    return "Both curves gain alike." if result == "alike" else f"More data helps {result} more."


def abstention_section(found: dict) -> str:
    """The cutoff that validation chose, and what it does on the test rows: the result of :func:`runs.abstention`."""
    row = found["test"]
    declined = row["total"] - row["answered"]
    trade = trade_sentence(found["cutoff"], declined, row["total"], found["base_accuracy"], row["selective_accuracy"], row["full_accuracy"])
    return f"## Declining to answer\n\n{sweep_table(found['points'])}\n\n{reliability_table(found['bins'])}\n\n{trade} {calibration_sentence(found['mean_gap'], found['signed_gap'])}\n"


def example_table(ranked: DataFrame) -> str:
    """Questions with their best labels: rows (question, rank, chapter, probability)."""
    best = ranked.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chapter", "probability"))), lambda x: F.format_string("%s (%.0f %%)", x["chapter"], x["probability"] * 100)), ", ").alias("best"))
    return table(best, {"question": "Question", "best": "Best labels"}, "question")


def report(title: str, *sections: str) -> str:
    return "\n".join([f"# {title}\n", *sections])
