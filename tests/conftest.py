import pytest
from pyspark.sql import SparkSession

from textloom.session import reachable


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(folder))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return reachable(s)
