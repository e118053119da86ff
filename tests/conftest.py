import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples, arrays as tuples."""

    def plain(x):
        if isinstance(x, (list, tuple)):
            return tuple(map(plain, x))
        return x

    return lambda df, *cols: sorted((plain(tuple(r)) for r in (df.select(*cols) if cols else df).collect()), key=repr)
