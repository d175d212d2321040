import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Asserts that a query and its SQL twin give the same bag of rows."""
    from collections import Counter

    def check(query, sql):
        df = query(spark, sf_dir)
        got = Counter(tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        want = Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
        assert sorted(names) == sorted(df.columns)
        assert got == want

    return check
