import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, repeated rows and columns with clashing names."""

    def make(texts, **extra):
        rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", 0, "x", 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, secrets string, n_words long")

    return make
