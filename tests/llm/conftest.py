import pytest


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, source), with a clashing extra column."""

    def make(rows, **more):
        full = [(r[0], r[1], more.get("lang", "en"), r[2] if len(r) > 2 else "src0", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, length string")

    return make
