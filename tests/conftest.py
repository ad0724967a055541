import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from scriptorium.functions.cluster import ship

    ship(session)
    yield session


def plain(x):
    """A value in a form that Spark's and DuckDB's rows share."""
    if x is None or isinstance(x, float) and x != x or str(x) == "<NA>":
        return "~"
    if isinstance(x, float) and x == int(x):
        return str(int(x))
    return str(x.tolist()) if hasattr(x, "tolist") and hasattr(x, "__len__") else str(x)


def rows_of(frame):
    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c
