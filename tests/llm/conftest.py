import pytest

from tallyforge.llm.common import at_workers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, n_words string, keep_id string, digest string, length string, `odd name` int"


@pytest.fixture(scope="session")
def workers(spark):
    return at_workers(spark)


@pytest.fixture
def docs(workers):
    """Documents from (doc_id, text) with nulls elsewhere and further columns whose names clash with results."""

    def make(rows):
        return workers.createDataFrame([(i, t, None, None, None, "s", None, "w", "k", None, "l", 1) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join(f"w{i % 977} v{i % 311}" for i in range(12000))
    base = " ".join(f"word{i}" for i in range(40))
    return [
        (1, None), (2, ""), (3, "  \t\n "), (4, base), (5, base), (6, base.upper()), (7, base + " end"), (8, long), (9, long + " tail"),
        (10, "one two three"), (11, "One  Two\tthree"), (12, "!!! 123"), (13, "Ein kurzer Satz mit ß und ü."), (14, "日本語のテキスト ☃ 𐍈"), (15, "a" * 5000),
        (16, "x y " * 400), (17, base), (None, base), (None, None), (5, base),
    ]
