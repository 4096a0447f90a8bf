"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from oracle import duck_rows, spark_rows

from huespan.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    want_names, want = duck_rows(ORACLES[name], sf)
    assert names == want_names
    assert len(rows) == len(want)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
