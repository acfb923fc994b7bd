"""Every library query against its SQL, or at least to its end."""

import pytest

from stackroom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck, compare):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        compare(df, duck.execute(SQL[name]))
    else:
        assert df.collect() is not None


def test_sql_is_of_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 20
    assert set(QUERIES) <= set(__spark_entry__.queries())
