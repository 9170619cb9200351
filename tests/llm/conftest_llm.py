import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string, component_id string, length string, `a` string, `x.y z` string, target string, fp long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]), with extra columns whose names clash with those of results."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], *(list(r[3:4]) or ["en"]), *(list(r[2:3]) or ["s"]), -1, 7, "x", "y", "z", None, "dot", "t", 5) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


MESSY = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "the QUICK brown fox jumps over the lazy dog"),
    (6, "one two"),
    (6, "one two"),
    (7, "one two", None),
    (None, "no number"),
    (None, None, None, None),
    (8, "Ünïcödé wörds 漢字 😀 and more words here", "t", None),
    (9, "word " * 5000, "t", "fr"),
    (10, "x" * 200_000, "t"),
]


@pytest.fixture
def messy(make_docs):
    return make_docs(MESSY)


@pytest.fixture
def empty(make_docs):
    return make_docs([])
