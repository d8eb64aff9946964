import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over one row of named strings."""
    from pyspark.sql import functions as F

    def value(column, **row):
        frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]) if row else spark.range(1)
        return frame.select(column.alias("x")).first()["x"]

    return value
