import pytest

from tripcast.llm.common import package_on_workers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string"


@pytest.fixture(scope="session")
def llm(spark):
    package_on_workers(spark)
    return spark


@pytest.fixture(scope="session")
def odd_documents(llm):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    columns whose names clash with results."""
    base = " ".join(f"w{i % 97}x{i % 89}" for i in range(400))
    near = base.replace("w5x5 ", "changed ", 1)
    rows = [(0, base), (1, near), (2, base), (3, ""), (4, None), (5, "a b"), (6, "A  b"), (7, "###\n\n###"),
            (8, "x" * 30000), (None, base), (None, None), (9, "dup row here now ok"), (9, "dup row here now ok"),
            (10, "the <|endoftext|> mark é 你好 " * 20), (11, base + " tail of its own " + base), (20, "1 2 3")]
    rows = [(i, t, None if i == 4 else "en", None, None if t is None else len(t), 1.0, "w") for i, t in rows]
    return llm.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(llm):
    return llm.createDataFrame([], SCHEMA)
