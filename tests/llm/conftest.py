import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from riskframe.llm.common import prepared

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def documents(llm, data):
    return llm.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(data):
    """The documents as a dict of texts by id."""
    t = ds.dataset(f"{data}/documents.parquet").to_table().to_pylist()
    return {r["doc_id"]: r["text"] for r in t}


ROWS = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one two three", "a"), (4, "one two three", "a"), (5, "One TWO three", "b"),
    (None, "a text without an id, but with words", "b"), (6, LONG, "b"), (7, LONG, None), (8, "x" * 50_000, "c"), (9, "naïve café 😀 日本語\x0bend", "c"),
]


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls, empty, blank, repeated, equal and very long texts, and columns named like the operators' own."""
    frame = llm.createDataFrame(ROWS, "doc_id long, text string, source string")
    for name in ("kept", "score", "size", "key", "c", "label", "n_words", "spans", "row", "ids", "tie", "at_", "range_", "root", "n_chars"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
