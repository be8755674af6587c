import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows, and columns with names that operators use inside."""
    long = "lorem ipsum dolor sit amet " * 20000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "a", 1), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "a", 1), (2, None, None, None), (3, "", "b", 2), (4, " \t\n ", "b", 3),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", None, 4), (5, "word", "c", 5), (6, "word", "c", 6), (7, long, "d", 7), (8, "Ünïcödé   text 123 ABC", "e", 8), (9, "x y z", "e", 9), (10, "X Y Z", "e", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, set int").withColumnRenamed("set", "rank")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
