"""Every registered query against its oracle; those without one must give rows."""

import pytest
from compare import oracle_rows, spark_rows

from corpuswright.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    names, rows = spark_rows(df, 9)
    if name in SQL:
        want_names, want = oracle_rows(SQL[name], sf, 9)
        assert names == want_names
        assert rows == want
    assert sum(rows.values()) > 0, "the query is vacuous on the test data"
