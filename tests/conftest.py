import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from stackroom.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(DATA):
        name = t.removesuffix(".parquet")
        path = f"{DATA}/{t}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{t}") else "")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    """Values of both engines in one form."""
    import datetime
    import decimal

    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def same_rows(df, cursor):
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want


@pytest.fixture(scope="session")
def compare():
    return same_rows
