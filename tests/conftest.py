"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from skein.views import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same(df, con, sql):
    """Whether a DataFrame and a DuckDB query hold the same rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    key = sorted(df.columns)
    assert key == sorted(names)
    show = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)
    a = sorted([show(r[c]) for c in key] for r in df.collect())
    b = sorted([show(r[names.index(c)]) for c in key] for r in found.fetchall())
    assert a == b
    return a
