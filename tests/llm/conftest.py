import pytest

@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of documents from (doc_id, text, source) rows, with columns whose names operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, rid long, digest string, own_digest string, own_rid long, mix_id long, print long, key string, pos int, size long, g long, bucket long"
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), *[None] * 12) for i, t, s in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    rows = [(1, "same text\nhere it is, quite long", "a"), (2, "same  text\nhere it is, quite long", "a"), (3, None, None), (4, "", "a"), (5, " \t\n ", "b"), (6, long, "b"), (7, long + " more", None), (None, "same text\nhere it is, quite long", "a"), (8, "x", "c"), (8, "x", "c"), (9, "Éa ß 日本 \U0001f3b5 ok", "c"), (10, "HERE IT IS, QUITE LONG", "a")]
    return docs_of(rows), rows


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
