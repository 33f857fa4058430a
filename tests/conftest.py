import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.config import parse_config  # noqa: E402
from tidemark.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def work(spark, tmp_path):
    """Point the shared folder at this test's own directory if none is set."""
    if spark.conf.get("spark.checkpoint.dir", None):
        yield tmp_path
    else:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path / "work"))
        yield tmp_path
        spark.conf.unset("spark.checkpoint.dir")


@pytest.fixture
def config(tmp_path):
    return parse_config({"paths": {"data_dir": str(tmp_path / "data")}})


@pytest.fixture(scope="session")
def evaluate(spark):
    """``evaluate(column_function, values)``: the function over a string column."""
    from pyspark.sql import functions as F

    def run(fn, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i long, v string")
        out = rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()
        return [r["x"] for r in out]

    return run
