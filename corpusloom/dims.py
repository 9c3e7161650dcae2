"""The label dictionary and the spellings that resolve to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The labels in canonical order (the position is the class id), with display names.
CHAPTERS = {
    "apgp": "APGP",
    "sequences-and-series": "SEQUENCES AND SERIES",
    "equations-and-inequalities": "EQUATIONS AND INEQUALITIES",
    "functions": "FUNCTIONS",
    "curve-sketching": "CURVE SKETCHING",
    "vectors-1": "VECTORS 1",
    "vectors-2": "VECTORS 2",
    "complex-numbers": "COMPLEX NUMBERS",
    "differentiation-and-its-applications": "DIFFERENTIATION AND ITS APPLICATIONS",
    "maclaurin-series": "MACLAURIN SERIES",
    "integration-techniques": "INTEGRATION TECHNIQUES",
    "applications-of-integration": "APPLICATIONS OF INTEGRATION",
    "differential-equations": "DIFFERENTIAL EQUATIONS",
    "permutations-and-combinations": "PERMUTATIONS AND COMBINATIONS",
    "probability": "PROBABILITY",
    "discrete-random-variables": "DISCRETE RANDOM VARIABLES",
    "binomial-distribution": "BINOMIAL DISTRIBUTION",
    "normal-distribution": "NORMAL DISTRIBUTION",
    "sampling": "SAMPLING",
    "hypothesis-testing": "HYPOTHESIS TESTING",
    "correlation-and-regression": "CORRELATION AND REGRESSION",
}

# Lower-cased folder spellings that name a label.
ALIASES = {
    "sns": "sequences-and-series",
    "sequence and series": "sequences-and-series",
    "equation and inequalities": "equations-and-inequalities",
    "equations-inequalities": "equations-and-inequalities",
    "graph and transformation": "curve-sketching",
    "curve sketching + transformations": "curve-sketching",
    "transformations": "curve-sketching",
    "differentiation": "differentiation-and-its-applications",
    "differenciation": "differentiation-and-its-applications",
    "differentiation-applications": "differentiation-and-its-applications",
    "differenciation and its application": "differentiation-and-its-applications",
    "maclaurin": "maclaurin-series",
    "integration": "integration-techniques",
    "integration application": "applications-of-integration",
    "pnc": "permutations-and-combinations",
    "p and c": "permutations-and-combinations",
    "drv": "discrete-random-variables",
    "correlation-regression": "correlation-and-regression",
    "c and r": "correlation-and-regression",
    "de": "differential-equations",
}

SLUGS = tuple(CHAPTERS)


def labels(spark: SparkSession) -> DataFrame:
    """class_id, slug, name."""
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(CHAPTERS.items())], "class_id int, slug string, name string")


def spellings(spark: SparkSession) -> DataFrame:
    """Every key that resolves to a label, with the rank of its rule: slug, alias, hyphenated, display name."""
    rows = [(s, "exact", 1, s) for s in CHAPTERS] + [(a, "exact", 2, s) for a, s in ALIASES.items()] + [(s, "hyphenated", 3, s) for s in CHAPTERS] + [(n.lower(), "exact", 4, s) for s, n in CHAPTERS.items()]
    return spark.createDataFrame(rows, "key string, form string, priority int, slug string")
