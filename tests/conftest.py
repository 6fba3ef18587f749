import os

os.environ.setdefault("TZ", "UTC")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/thermal-lake-warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
