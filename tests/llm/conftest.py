import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long_text = " ".join(f"word{k % 977} the{k % 7}" for k in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "", "en", None, 0), (3, None, None, None, None),
        (4, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (5, long_text, "en", "b", len(long_text)),
        (5, long_text, "en", "b", len(long_text)), (None, "without an id", "en", "b", 13), (7, "ü " * 50, "de", "c", 100), (8, "one", None, "c", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clashing = "fp score predicted kept log_weight gumbel_key key pieces decoded secret_spans tmp_t tmp_key rot u v worker nth component_id carried".split()
    return df.selectExpr("*", *(f"'x' AS {c}" for c in clashing))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
