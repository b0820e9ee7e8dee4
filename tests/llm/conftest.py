import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table: rows of (doc_id, text[, lang[, source]]), and a column that clashes with inner names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "clash", 7) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, k string, th long"
        )

    return make
