"""Every registered query with SQL gives the rows that DuckDB gives; the others give rows."""

import pytest

from residua import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, sf_dir, name):
    columns, rows = oracle.of_frame(catalog.QUERIES[name](spark, sf_dir))
    want_columns, want = oracle.of_sql(con, catalog.SQL[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert all(oracle.close(x, y) for a, b in zip(rows, want) for x, y in zip(a, b)), next((a, b) for a, b in zip(rows, want) if not all(map(oracle.close, a, b)))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
