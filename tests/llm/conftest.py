import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, found string, node string"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names clash with those the operators use inside."""

    def make(texts, first=0, langs=None):
        rows = [(first + i, t, langs[i] if langs else "en", "s", 0, "r", "f", "n") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def odd_texts():
    """Nothing, white space, symbols, one word, a very long text, a repeated text."""
    return [None, "", " \n\t", "***", "word", "ab cd " * 30_000, "word", "ÀÉ ñ 漢字 🙂 naïve"]
