import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollbook.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="rollbook-tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Ragged rows from a list of dicts, in order."""

    def make(items, **constants):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(
            [(i, item) for i, item in enumerate(items)], "ordinal bigint, fields map<string,string>"
        )
        for name, value in constants.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture
def dicts():
    """Rows back as dicts in arrival order."""

    def read(df):
        return [r["fields"] for r in df.orderBy("ordinal").collect()]

    return read
