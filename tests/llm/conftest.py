import pytest

from hearthpanel.llm.common import prepare_workers

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, bits string, key string, mark int, x int, found int, score string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source); further columns have names the operators use inside."""
    prepare_workers(spark)

    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t), 1, "b", "k", 2, 3, 4, "s") for i, t, lang, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, ids, languages and sources; repeated rows; ties; a very long text; no letter."""
    text = "the cat sat on the mat and the dog ran to the house with a bone in its mouth"
    return [
        (1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", "b"), (3, None, "en", "a"), (4, "", None, None),
        (None, text + " again", None, "b"), (None, None, "en", None), (5, "12 34 -- !!", "de", "c"),
        (6, "\n \t\x0b ", "de", "c"), (7, "der Hund und die Katze im Haus " * 8000, "de", "c"),
        (8, "x" * 50_000, "de", "c"), (9, "ünïcödé \U0001f600 中文 ó K", "fr", "c"),
    ]


@pytest.fixture(scope="session")
def sf_docs(spark):
    return prepare_workers(spark).read.parquet(f"{SF}/documents.parquet")
