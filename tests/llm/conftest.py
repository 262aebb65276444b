import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from codesieve.llm.common import ship_package

    ship_package(spark)


@pytest.fixture
def docs_of(spark):
    """docs_of([(doc_id, text, lang, source)]) with the columns of documents, and two that clash."""

    def build(rows):
        full = [(a, b, c, d, None if b is None else len(b), 7, "x") for a, b, c, d in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, id long, `key` string")

    return build


@pytest.fixture
def as_dicts():
    def rows(df, *keys):
        return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: [str(r[k]) for k in keys])

    return rows


ODD = [
    (1, None, None, None), (2, "", "en", None), (3, " \t\n", "en", "a"), (4, "one", "en", "a"),
    (5, "one", "en", "b"), (5, "one", "en", "b"), (6, "123 !!", "en", "b"), (None, "one two", "en", "c"),
    (7, "word " * 30000, "en", "c"), (8, "Été çà là " * 5, "fr", "c"), (9, "a\x00b  c", "fr", "é"),
    (10, "𝔘𝔫𝔦 code 🙂 " * 4, "fr", "z"),
]
