import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from leadloom.session import local_session

    session = local_session(8, partitions=8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a Column expression over one text column ``x`` and return the results in order."""
    from pyspark.sql import functions as F

    def run(build, rows, kind="string"):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
        return [r.v for r in df.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]

    return run
