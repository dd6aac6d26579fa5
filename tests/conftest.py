import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """The value of a column function on one string."""

    def value(function, text, *more):
        from pyspark.sql import functions as F

        schema = ", ".join(f"c{k} string" for k in range(1 + len(more)))
        row = spark.createDataFrame([(text, *more)], schema).select(function(*(F.col(f"c{k}") for k in range(1 + len(more)))).alias("v")).first()
        return row["v"]

    return value
