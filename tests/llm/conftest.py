import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes ``documents`` from ``(doc_id, text)`` or ``(doc_id, text, lang)``, with a clashing column."""

    def make(rows):
        rows = [(*r, None)[:3] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(
            [(i, t, lang, "s", len(t or ""), 1, "x") for i, t, lang in rows],
            "doc_id long, text string, lang string, source string, n_chars long, bucket long, text_hash string",
        )

    return make
