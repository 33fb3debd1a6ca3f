import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text[, lang]) with the table's columns and some that clash with working names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({n: F.lit(7) for n in ("k1", "k2", "c", "n", "x", "p", "a", "score", "lines", "row", "kept", "size", "_k1")})
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, blanks, a null id, repeated ids and rows, a very long text."""
    long = " ".join(f"word{i % 977} item{i % 31}" for i in range(30000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a text of a row without an id that goes on"), (4, "same id one"), (4, "same id two"), (5, "twin row text"), (5, "twin row text"), (6, long)]
