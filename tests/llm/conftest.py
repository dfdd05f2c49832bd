import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, k long"


@pytest.fixture
def table(spark):
    """Documents with further columns whose names operators use themselves."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", len(t or ""), 0.5, "x", 1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, repeated rows, long, and characters of all widths."""
    prose = " ".join(f"word{i % 97} thing{i % 31}" for i in range(400))
    return [None, "", " \n\t ", "one", prose, prose, "éa ñb ü😀 日本語 " * 50, "a" * 3000, "0123456789abcdef" * 4, prose + " tail of its own", "x " * 20000]
