"""Registered queries against their SQL."""

import pytest

from tests.check_oracles import compare
from tests.conftest import SMALL
from vectrail.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duckdb_small, name):
    extra, missing, rows = compare(spark, duckdb_small, name, SMALL)
    assert not extra and not missing and rows
