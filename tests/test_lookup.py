"""Rows by id: what is read, what is moved, and bucketed tables."""

import pytest

from tests.conftest import SMALL
from vectrail.operators.lookup import LISTED_IDS, attach_documents, lookup, lookup_ids, rows_by_id
from vectrail.plans.catalog.searching import colocated_documents
from vectrail.plans.catalog.standins import articles
from vectrail.sources.tables import read_articles_table, write_articles, write_bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scan of a table gives, and files that it opens."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    metrics = plan.collectLeaves().head().metrics()
    return metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("articles") / "table")
    many = spark.range(40_000).selectExpr(
        "cast(id AS string) AS pmid", "id AS doc_id", "concat('title ', id) AS title", "'x' AS authors",
        "repeat(md5(cast(id AS string)), 20) AS abstract", "2000 AS publication_year", "'2000' AS publication_year_raw",
    )
    write_articles(many.repartition(4, "doc_id"), path)
    return read_articles_table(spark, path)


@pytest.mark.parametrize("ids", [[], [3], [77, 3, 3, 50_000_000], list(range(0, 40_000, 500))])
def test_few_ids_are_a_filter_of_the_files(stored, ids):
    found = lookup_ids(stored, ids)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted({i for i in ids if i < 40_000})
    plan = plan_of(found)
    assert "Exchange" not in plan and "Join" not in plan
    if ids:
        assert "In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_single_ids_read_few_rows(stored):
    # Two pages of 1000 rows of two files; bloom filters leave out the other files' row groups.
    rows, _ = scanned(lookup_ids(stored, [3, 20_077]))
    assert 2 <= rows <= 4000


def test_many_ids_are_joined_and_texts_are_not_moved(spark, stored):
    ids = range(0, 40_000, 20)
    assert len(ids) > LISTED_IDS
    for found in (lookup_ids(stored, ids), lookup(stored, spark.range(0, 40_000, 20).withColumnRenamed("id", "doc_id"))):
        assert found.count() == len(ids)
    assert "BroadcastHashJoin" in plan_of(lookup_ids(stored, ids))


def test_few_hits_reach_the_files(spark, stored):
    hits = spark.createDataFrame([(7, 0.5), (9, 0.4), (99_999, 0.3), (None, 0.2)], "doc_id bigint, similarity double")
    rows = {r["doc_id"]: r["title"] for r in attach_documents(hits, stored).collect()}
    assert rows == {7: "title 7", 9: "title 9", 99_999: None, None: None}
    assert "In(doc_id" in plan_of(lookup(stored, hits))


def test_rows_without_an_id_on_request(spark):
    table = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (2, "d")], "doc_id bigint, x string")
    some = spark.createDataFrame([(1,), (None,)], "doc_id bigint")
    many = spark.range(5, 5 + 2 * LISTED_IDS).withColumnRenamed("id", "doc_id").unionAll(some)
    for ids in (some, many):
        assert sorted(r["x"] for r in rows_by_id(table, ids).collect()) == ["a"]
        assert sorted(r["x"] for r in rows_by_id(table, ids, nulls=True).collect()) == ["a", "b", "c"]


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(colocated_documents(spark, SMALL))
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        texts = write_bucketed(articles(spark, SMALL), "bucketed_articles", str(tmp_path / "a"), 16)
        hits = spark.range(0, 5000).selectExpr("id AS doc_id", "1.0D AS similarity")
        joined = attach_documents(hits, texts)
        assert joined.where("pmid is not null").count() == texts.count() == 200
        # Only the hits are dealt to the buckets; between the articles' scan and the join is no exchange.
        article_side = plan_of(joined).split("bucketed_articles")[0].rsplit("Join", 1)[-1]
        assert "Exchange" not in article_side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS bucketed_articles")


def test_few_ids_read_their_buckets_alone(spark, tmp_path):
    texts = write_bucketed(articles(spark, SMALL), "bucketed_lookup", str(tmp_path / "a"), 16)
    found = lookup_ids(texts, [3])
    assert [r["pmid"] for r in found.collect()] == ["3"]
    rows, _ = scanned(found)
    assert rows <= 40  # of 200, the rows of one bucket
    spark.sql("DROP TABLE bucketed_lookup")
