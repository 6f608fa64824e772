import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from leadweave.session import build_session

    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.default.parallelism": "4",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column function over a list of texts."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
        return [r[0] for r in df.select("n", fn(F.col("v")).alias("out")).orderBy("n").select("out").collect()]

    return run
