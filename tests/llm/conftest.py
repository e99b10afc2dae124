import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", 7),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", 7),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", 7),
    (3, None, "en", 0),
    (4, "", None, 0),
    (5, " \t\n\x0b ", "fr", 0),
    (None, "A row without an id, in no language.", None, 1),
    (6, LONG, "en", 9),
    (7, "mot " * 40, "fr", 9),
    (8, "mot " * 40, "fr", 9),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, kept int"


@pytest.fixture()
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and an extra column that clashes with an output's."""
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
