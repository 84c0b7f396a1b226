import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from reviewlens.session import local_session

    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def one(spark):
    """The value of a column expression over one row of named inputs."""
    from pyspark.sql import functions as F

    def evaluate(build, *values):
        row = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
        return row.select(build(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first()["x"]

    return evaluate
