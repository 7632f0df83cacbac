"""First copy wins, also when one key has most of the rows, and inserting into what is stored."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vectrail.operators.dedup import first_wins, upsert_ignore
from vectrail.operators.pooling import masked_mean_pool

SCHEMA = "pmid string, source_file string, source_row bigint, title string"
ORDER = ["source_file", "source_row"]


def rows_of(records):
    return [(k, f, n, f"{k}-{f}-{n}") for n, (k, f) in enumerate(records)]


def expected(rows):
    best = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        best.setdefault(row[0], row)
    return sorted(best.values())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    records=st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("xyz")), min_size=1),
    partitions=st.integers(1, 5),
)
def test_first_copy_wins(spark, records, partitions):
    rows = rows_of(records)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    assert sorted(map(tuple, first_wins(df, "pmid", ORDER).collect())) == expected(rows)


def test_one_key_with_most_rows_is_cut_down_before_the_shuffle(spark):
    df = spark.range(0, 30_000, 1, 6).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id AS string)) AS pmid",
        "concat('f', 9 - id div 5000) AS source_file",
        "id AS source_row",
    )
    kept = first_wins(df, "pmid", ORDER)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    partial = next(n for n, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line and "Partial" in line)
    exchange = next(n for n, line in enumerate(plan.splitlines()) if "Exchange" in line)
    assert exchange < partial
    assert kept.count() == 20_001
    assert tuple(kept.where("pmid = 'hot'").head()[1:]) == ("f4", 25_002)


def test_upsert_keeps_what_is_stored_and_can_be_repeated(spark):
    stored = spark.createDataFrame(rows_of([("a", "x"), ("b", "x")]), SCHEMA)
    incoming = spark.createDataFrame(rows_of([("b", "a"), ("c", "z"), ("c", "y")]), SCHEMA)
    once = upsert_ignore(stored, incoming, "pmid", ORDER)
    wanted = [("a", "a-x-0"), ("b", "b-x-1"), ("c", "c-y-2")]
    assert sorted((r["pmid"], r["title"]) for r in once.collect()) == wanted
    twice = upsert_ignore(once, incoming, "pmid", ORDER)
    assert sorted((r["pmid"], r["title"]) for r in twice.collect()) == wanted


@pytest.mark.parametrize("partitions", [1, 8])
def test_pooling_with_one_dominant_document(spark, partitions):
    tokens = spark.range(0, 9_000, 1, partitions).selectExpr(
        "if(id % 3 = 0, -1L, id div 10) AS doc_id", "1 AS mask", "array(float(id), 1f) AS vec"
    )
    pooled = dict(masked_mean_pool(tokens).collect())
    assert np.allclose(pooled[-1], [np.mean(np.arange(0, 9_000, 3)), 1.0])
    assert len(pooled) == 901
