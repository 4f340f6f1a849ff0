import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, node int, copies string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with names that operators use."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44, 9, "x", 1, "c"),
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44, 9, "x", 1, "c"),
        (2, "", "en", "a", 0, 9, "x", 1, "c"),
        (3, None, None, None, None, None, None, None, None),
        (None, "No id here, but some words all the same.", "en", None, 40, 9, "x", 1, "c"),
        (None, None, None, None, None, None, None, None, None),
        (4, LONG, "en", "b", len(LONG), 9, "x", 1, "c"),
        (5, "The quick brown fox jumps over the lazy dog.", "de", "b", 44, 9, "x", 1, "c"),
        (6, "1234 5678 %%% ###", "fr", "b", 17, 9, "x", 1, "c"),
        (7, "\n\n \t", "fr", "c", 4, 9, "x", 1, "c"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
