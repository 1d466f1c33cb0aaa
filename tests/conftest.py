import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plotwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", 4,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "4g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
           "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression for each of the given inputs."""
    def run(build, *inputs, type_="string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(
            [(i, v) for i, v in enumerate(inputs)], f"i int, v {type_}"
        )
        rows = df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in rows]
    return run
