import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, _n long"
ODD = [(1, None, None, None, None, None, None), (2, "", "en", "a", 0, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, " \n\t ", "en", "a", 4, None, None),
       (4, "one  two\nthree \u00a0x \x1c y é", "fr", "b", 20, None, 2), (None, "one two three four", "en", None, 18, None, None),
       (6, "the cat sat on the mat " * 4000, "en", "a", 92000, None, 3), (7, "one two three four", "en", "b", 18, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names the operators use inside."""
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
