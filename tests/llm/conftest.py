import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, rep long, row string, digest string"


def frame(spark, texts, ids=None):
    """A documents table with extra columns of clashing names."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2, "r", "d") for i, t in zip(ids, texts, strict=True)], DOC)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts, ids=None: frame(spark, texts, ids)
