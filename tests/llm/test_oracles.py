"""Queries that SQL can express give the rows of their SQL; every query is registered under its number."""

import re

import pytest
from oracle import duck_rows, spark_rows

from huespan.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    want_names, want = duck_rows(ORACLES[name], sf)
    assert names == want_names
    assert rows == want


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
