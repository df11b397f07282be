"""The driver's contract."""

import __spark_entry__ as driver


def test_names_and_sql():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 80
    assert all(callable(q) for q in queries.values())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["feature", "f"] and df.count() == 10
