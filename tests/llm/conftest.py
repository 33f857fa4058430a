import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """``frame(rows)``: rows of (doc_id, text) as a documents table."""

    def make(rows, langs=None):
        langs = langs or [None] * len(rows)
        full = [(i, t, g, "s", None if t is None else len(t)) for (i, t), g in zip(rows, langs)]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, blanks, repeats, one very long text and one very long word."""
    text = "One two three four. Five six seven eight nine ten eleven."
    return [
        (1, text), (1, text), (2, None), (3, ""), (4, " \t\n"), (None, text), (None, None),
        (5, "x"), (6, "word " * 60_000), (7, "a" * 300_000), (8, text + " twelve"),
    ]
