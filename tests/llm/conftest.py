import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows():
    """Rows of a test table as tuples."""
    def read(name: str, columns: str = "*", sf: str = SF):
        return duckdb.sql(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()
    return read


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    data = [
        (1, "one two three four five six", "en", "b", 27, "x", 1), (2, None, "en", "a", None, "y", 2),
        (3, "", None, None, 0, None, 3), (None, "no id here", "fr", "a", 10, "k", 4),
        (None, "no id here", "fr", "a", 10, "k", 4), (4, long, "en", "b", len(long), "z", 5),
        (5, "One two THREE four five six", "de", None, 27, "", 6), (5, "One two THREE four five six", "de", None, 27, "", 6),
        (6, " \t\n\r ", "es", "", 5, "q", 7), (-7, "all rights reserved. All Rights\nReserved!", "en", "b", 41, "r", 8),
        (9, "é ñ 東京 \U0001F600 naïve", "en", "a", 15, "s", 9), (10, "one", "en", "a", 3, "t", 10)]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, key string, score long")
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
