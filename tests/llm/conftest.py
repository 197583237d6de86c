import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of green herbs in the old tower"


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, odd characters."""
    long_ = " ".join(f"word{i % 977} Über{i % 31}" for i in range(150_000))  # over a block of two megabytes
    lines = "\n".join(f"line {i} of a text that has some words" for i in range(6))
    return [
        (1, PROSE, "en", "a", 1),
        (2, PROSE, "en", "a", 1),
        (3, PROSE.upper(), "en", None, 1),
        (4, None, "en", "b", 1),
        (5, "", "de", "b", 0),
        (6, " \n\t\r\n ", None, "b", 5),
        (7, "one", "en", "b", None),
        (8, "ONE", None, "c", 3),
        (None, PROSE + " again", "en", "c", 1),
        (None, None, None, None, None),
        (9, long_, "en", "c", 1),
        (10, long_ + " more", "en", "c", 1),
        (11, lines, "en", "d", 1),
        (12, "first\n" + lines + "\nlast", "en", "d", 1),
        (12, "first\n" + lines + "\nlast", "en", "d", 1),
        (13, "a\na\na\na\na\na", "en", "", 1),
        (14, "日本語 の 文章 \u00a0nbsp 😀 emoji , . !", "en", "é", 1),
        (15, "Released under the MIT License. " + PROSE, "en", "😀", 1),
        (16, "x " * 40 + "y", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENT).repartition(3, "source")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def table(spark, edges, tmp_path_factory):
    """The edge cases as a table, in two files."""
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    edges.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def sql():
    import os

    import duckdb

    c = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for f in os.listdir(d):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{d}/{f}'")
    return c
