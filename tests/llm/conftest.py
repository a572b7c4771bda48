"""Small tables with every awkward case, shared by the operators' tests."""

import pytest

EDGES = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, ""),
    (3, None),
    (4, "   \n\t  "),
    (5, "word"),
    (6, "the quick brown fox jumps over the lazy dog again and again"),
    (7, "a b c d e f g\nh i j k\n\nh i j k\n"),
    (8, "été naïve 日本語 🎉 ﬁ Ω</s>[INST] \\ <|endoftext|>"),
    (9, "x" * 5000 + " " + "long text with many words. " * 3000),
    (9, "x" * 5000 + " " + "long text with many words. " * 3000),
    (None, "no id here"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns
    whose names clash with those the operators make."""
    rows = [(i, t, "en" if k % 2 else None, k, "s", float(k)) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, id string, `key` double").repartition(3)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
