"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare
from tests.conftest import SMALL
from vectrail.plans.catalog import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_returns_ranked_documents(spark):
    rows = entry.entry(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert rows[0]["doc_id"] == 0 and rows[0]["similarity"] == 1.0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duckdb_small, name):
    extra, missing, rows = compare(spark, duckdb_small, name, SMALL)
    assert not extra and not missing
    assert rows
