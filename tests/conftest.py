import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Python workers import the functions of the test modules by name.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("folioflow-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate_text(spark):
    """Value of a text expression for each given text."""

    def run(expression, *texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame(rows, "i INT, text STRING").coalesce(1)
        return [r.v for r in frame.select("i", expression.alias("v")).orderBy("i").collect()]

    return run
