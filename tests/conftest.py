import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """One result column of an expression over a list of inputs."""
    def run(inputs, kind, expression):
        frame = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
        column = F.expr(expression) if isinstance(expression, str) else expression(F.col("x"))
        shown = frame.select("i", column.alias("y"))
        return [row.y for row in sorted(shown.collect(), key=lambda r: r.i)]

    return run
