import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SPHERES = [(x, y, z, r) for x, y, z in [(1.0, 1.0, 1.0), (3.0, 1.0, 1.0), (3.0, 3.0, 1.0), (1.0, 3.0, 1.0), (1.0, 1.0, 3.0), (3.0, 1.0, 3.0), (3.0, 3.0, 3.0)] for r in (0.8, 0.5)] + [(1.0, 3.0, 3.0, 0.8), (2.0, 2.0, 2.0, 2.0)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def spheres(spark):
    return spark.createDataFrame(SPHERES, "x double, y double, z double, radius double").coalesce(2)
