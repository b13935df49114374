import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailpolicy import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = (
        session.builder("tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def lines(spark):
    """Lines of text as the readers take them."""
    return lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")


def as_set(df):
    return {tuple(r) for r in df.collect()}
