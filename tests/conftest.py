import os
import sys

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from shelfline import schemas  # noqa: E402
from shelfline.session import configure  # noqa: E402
from samples import PRACTICE_ROWS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def categories(spark):
    rows = [
        (1, "alpha", None, 1),
        (2, "Alpha", "second", 2),
        (3, "Zeta", None, None),
        (4, "unused", None, 0),
    ]
    return spark.createDataFrame(rows, schemas.CATEGORIES)


@pytest.fixture(scope="session")
def features(spark):
    rows = [
        (10, "proxy", "https://example.org/proxy", "Free"),
        (11, "cache", "", "Pro"),
        (12, "idle", None, None),
    ]
    return spark.createDataFrame(rows, schemas.FEATURES)


@pytest.fixture(scope="session")
def practices(spark):
    rows = [(*row, None, None) for row in PRACTICE_ROWS]
    return spark.createDataFrame(rows, schemas.PRACTICES)
