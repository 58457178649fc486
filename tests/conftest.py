from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ridgeline import get_session, ship_package

    session = get_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """501 rows and 10 features that come with the PySpark package."""
    import pyspark
    from pyspark.sql import functions as F

    path = os.path.join(pyspark.__path__[0], "data", "mllib", "sample_linear_regression_data.txt")
    rows = spark.read.format("libsvm").option("numFeatures", "10").load(path)
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    return rows.withColumn("fold", F.pmod("id", F.lit(3)).cast("int")).cache()
