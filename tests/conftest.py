import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfmark.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship_package(local_session(8))
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluate a column over a single text, ``one(value, column)``."""
    from pyspark.sql import functions as F

    def run(value, build, kind="string"):
        df = spark.createDataFrame([(value,)], f"t {kind}")
        return df.select(build(F.col("t")).alias("r")).first()["r"]

    return run
