import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import local_session

    session = local_session("4", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture
def value(spark):
    """Evaluate one column expression over a single row of named values."""

    def run(expression, **columns):
        from pyspark.sql import functions as F

        frame = spark.range(1).select(*[
            (F.lit(None).cast("string") if v is None else F.lit(v)).alias(k) for k, v in columns.items()
        ] or [F.lit(1).alias("one")])
        return frame.select(expression.alias("x")).first()["x"]

    return run
