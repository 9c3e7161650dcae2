import pytest
from hypothesis import settings

settings.register_profile("steady", deadline=None)
settings.load_profile("steady")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) with the further columns of the documents table."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, ties and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog again and again"
    return [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "word " * 30_000), (None, "no id"), (6, "  spaced \t out \n lines \n\n"), (7, "Ünïcödé 漢字 🙂 \x00 end"), (8, "x" * 70_000)]
