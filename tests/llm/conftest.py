import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text[, lang[, source]]) rows, with extra columns of clashing names."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("keep_id", "kept", "rows", "sha", "bucket", "key", "size", "rank", "score", "_gone_id", "component_id", "_word", "doc"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
