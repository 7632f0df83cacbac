"""Top-k selection: one query, many queries, restricted searches."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vectrail.operators.batch_search import Rounds, search_batch
from vectrail.operators.lookup import attach_documents, lookup, lookup_ids
from vectrail.operators.profile import with_norm
from vectrail.operators.search import search, with_rank
from vectrail.operators.selection import nth_key, smallest_by_key
from vectrail.plans.catalog.standins import articles, stretched_vectors, vectors
from vectrail.sources.tables import pack_vectors


def plain(df):
    return [(r["doc_id"], r["similarity"]) for r in df.collect()]


def brute_force(table, query, k):
    rows = table.select("doc_id", "doc_vector").collect()
    ids = np.array([r[0] for r in rows])
    matrix = np.array([r[1] for r in rows], dtype=float)
    scores = matrix @ query / np.maximum(np.linalg.norm(matrix, axis=1) * np.linalg.norm(query), 1e-5)
    scores = np.round(scores, 12)
    return [int(ids[i]) for i in np.lexsort((ids, -scores))[:k]]


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("engine", ["arrow", "expr"])
def test_top_k_does_not_depend_on_partitions(spark, partitions, engine):
    table = stretched_vectors(spark, SMALL)
    query = table.where("doc_id = 7").head()["doc_vector"]
    found = search(table.repartition(partitions), query, 12, engine=engine)
    assert [i for i, _ in plain(found)] == brute_force(table, np.array(query), 12)


def test_k_beyond_the_table_and_zero(spark):
    table = vectors(spark, SMALL).limit(5)
    query = table.head()["doc_vector"]
    assert len(plain(search(table, query, 50))) == 5
    assert plain(search(table, query, 0)) == []
    with pytest.raises(ValueError):
        search(table, query, -1)


def test_equal_scores_are_ordered_by_id(spark):
    table = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.array(F.lit(0.1), F.lit(0.7)).cast("array<float>").alias("doc_vector")
    )
    found = search(table.repartition(9), [0.3, 0.2], 4)
    assert [i for i, _ in plain(found)] == [0, 1, 2, 3]
    assert [r["rank"] for r in with_rank(found).orderBy("doc_id").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 2, 999, 1000, 1001, 5000])
def test_smallest_keys(spark, n):
    keys = sorted({(i * i * 7919) % 1_000_003 - 500_000 for i in range(990)} | {-(2**62), 2**62})
    df = spark.createDataFrame([(k,) for k in keys], "key bigint").repartition(5)
    kept = sorted(r[0] for r in smallest_by_key(df, "key", n).collect())
    assert kept == keys[:n]


def test_smallest_keys_with_one_dominant_key(spark):
    df = spark.range(900).selectExpr("if(id < 600, 5L, id - 700) AS key")
    kept = sorted(r[0] for r in smallest_by_key(df, "key", 300).collect())
    assert kept == sorted(([5] * 600 + [i - 700 for i in range(600, 900)]))[:300]
    assert nth_key(df, "key", 301) == (5, 105, 601)
    assert nth_key(df, "key", 901) is None
    assert smallest_by_key(df, "key", 0).count() == 0


def queries_of(table, ids):
    return table.where(F.col("doc_id").isin(ids)).selectExpr("doc_id AS query_id", "doc_vector AS query_vector")


def batch_rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["similarity"]) for r in df.collect())


def single_rows(table, queries, k, **options):
    return sorted(
        (q["query_id"], rank, doc, score)
        for q in queries.collect()
        for rank, (doc, score) in enumerate(plain(search(table, q["query_vector"], k, **options)), 1)
    )


@pytest.mark.parametrize("merge_groups", [1, 16])
@pytest.mark.parametrize("metric,clamp", [("cosine", "product"), ("cosine", "doc"), ("dot", "doc")])
def test_batch_equals_single_searches(spark, metric, clamp, merge_groups):
    table = stretched_vectors(spark, SMALL).repartition(6)
    queries = queries_of(table, [0, 3, 11])
    options = {"metric": metric, "clamp": clamp}
    found = search_batch(table, queries, 7, merge_groups=merge_groups, **options)
    expected = single_rows(table, queries, 7, **options)
    assert [r[:3] for r in batch_rows(found)] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in batch_rows(found)], [r[3] for r in expected])


def test_batch_in_blocks_equals_one_block(spark):
    table = stretched_vectors(spark, SMALL).repartition(4)
    queries = queries_of(table, list(range(23)))
    whole = batch_rows(search_batch(table, queries, 5))
    blocks = batch_rows(search_batch(table, queries, 5, max_query_bytes=5 * 64 * 8))
    assert len(whole) == 23 * 5
    assert [r[:3] for r in whole] == [r[:3] for r in blocks]


def test_batch_over_packed_vectors_and_codes(spark):
    table = stretched_vectors(spark, SMALL)
    queries = queries_of(table, [1, 2])
    assert batch_rows(search_batch(pack_vectors(table), queries, 3)) == batch_rows(
        search_batch(table, queries, 3)
    )


def test_batch_with_many_copies_of_one_vector(spark):
    table = spark.range(0, 30_000, 1, 7).selectExpr(
        "id AS doc_id",
        "cast(if(id % 3 = 0, array(1, 1), array(1, id / 30000)) AS array<float>) AS doc_vector",
    )
    queries = spark.createDataFrame(
        [("x", [1.0, 1.0]), ("y", [1.0, 0.0])], "query_id string, query_vector array<double>"
    )
    found = batch_rows(search_batch(table, queries, 6))
    assert [r[2] for r in found if r[0] == "x"] == [0, 3, 6, 9, 12, 15]
    assert [r[2] for r in found if r[0] == "y"] == [1, 2, 4, 5, 7, 8]


def test_batch_edge_cases(spark):
    table = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, None), (4, [0.0, 1.0])],
        "doc_id bigint, doc_vector array<float>",
    )
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, query_vector array<float>")
    with pytest.raises(PySparkException, match="undefined similarity"):
        search_batch(table, queries, 2).collect()
    found = search_batch(table, queries, 5, on_nan="drop")
    assert batch_rows(found) == [(9, 1, 1, 1.0), (9, 2, 4, 0.0)]
    assert search_batch(table, queries.limit(0), 2).collect() == []
    with pytest.raises(ValueError, match="unique"):
        search_batch(table, queries.unionAll(queries), 2)
    zero = spark.createDataFrame([(9, [0.0, 0.0])], queries.schema)
    with pytest.raises(ValueError, match="zero query"):
        search_batch(table, zero, 2, clamp="doc")


def test_documents_stay_with_their_scores(spark):
    hits = spark.createDataFrame(
        [(3, 0.9), (100_000, 0.8), (1, 0.7)], "doc_id bigint, similarity double"
    )
    table = articles(spark, SMALL)
    rows = {r["doc_id"]: r for r in attach_documents(hits, table).collect()}
    assert {i: r["pmid"] for i, r in rows.items()} == {3: "3", 1: "1", 100_000: None}
    assert rows[3]["similarity"] == 0.9
    for found in (lookup_ids(table, [3, 100_000, 1]), lookup(table, hits)):
        assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]


def test_lookups_take_any_number_of_ids(spark):
    table = articles(spark, SMALL)
    assert lookup_ids(table, range(5_000)).count() == table.count()
    hits = spark.range(5_000).selectExpr("id AS doc_id", "1.0D AS similarity")
    assert attach_documents(hits, table).where("pmid IS NOT NULL").count() == table.count()


def test_null_ids_are_found_by_both_searches(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "doc_id bigint, doc_vector array<float>")
    one = [(r["doc_id"], r["similarity"]) for r in search(table, [1.0, 0.0], 2).collect()]
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, query_vector array<float>")
    many = search_batch(table, queries, 2).orderBy("rank").collect()
    assert one == [(r["doc_id"], r["similarity"]) for r in many] == [(None, 1.0), (1, 1.0)]


def test_many_hits_per_query_in_blocks(spark):
    table = spark.range(1500).selectExpr("id AS doc_id", "array(float(id), 1.0f) AS doc_vector")
    queries = spark.range(6).selectExpr("id AS query_id", "array(1.0f, float(id)) AS query_vector")
    whole = search_batch(table, queries, 1000, metric="dot")
    cut = search_batch(table, queries, 1000, metric="dot", max_query_bytes=2 * 1000 * 72)
    assert whole.count() == 6000
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def clustered(spark, rows, parts):
    """Vectors in 20 directions, many equal, dealt by id."""
    return spark.range(0, rows, 1, parts).selectExpr(
        "id AS doc_id",
        "transform(sequence(1, 16), i -> float(sin(i * (id % 20)) + 0.1 * cos(i * (id % 997)))) AS doc_vector",
    )


@pytest.mark.parametrize("k", [10, 1000])
def test_rounds_return_the_same_hits_but_few_of_them(spark, k):
    parts, rows = 24, 24_000
    table = clustered(spark, rows, parts)
    queries = table.where("doc_id < 10").selectExpr("doc_id AS query_id", "doc_vector AS query_vector")
    all_at_once, in_rounds = [], []
    whole = search_batch(table, queries, k, returned=all_at_once)
    cut = search_batch(table, queries, k, rounds=Rounds(first_rows=k, growth=3), returned=in_rounds)
    assert batch_rows(cut) == batch_rows(whole)
    assert all_at_once == [10 * min(k * parts, rows)]
    # The first part returns all its hits, about k; a later one at most 3 k a query.
    assert len(in_rounds) >= 4 and max(in_rounds) <= 10 * 3 * k
    assert sum(in_rounds) < all_at_once[0] or k > rows // parts


def test_rounds_by_file_read_each_file_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    clustered(spark, 6000, 12).write.parquet(path)
    table = spark.read.parquet(path)
    queries = table.where("doc_id < 5").selectExpr("doc_id AS query_id", "doc_vector AS query_vector")
    whole = batch_rows(search_batch(table, queries, 10))
    rounds = Rounds(first_rows=600, growth=3, by="file")
    assert batch_rows(search_batch(table, queries, 10, rounds=rounds)) == whole
    files = 0
    for low, high in rounds.parts(6000):
        part = table.where((rounds.share() >= low) & (rounds.share() < high)).select("doc_id")
        plan = part._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        files += plan.collectLeaves().head().metrics().apply("numFiles").value()
    assert files == 12


def test_rounds_with_null_and_repeated_ids(spark):
    rows = [(None, [1.0, float(i % 3)]) for i in range(40)] + [(7, [1.0, 0.5])] * 30 + [(i, [0.0, 1.0]) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id bigint, doc_vector array<float>").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "query_id bigint, query_vector array<float>")
    key = lambda df: sorted((r["query_id"], r["rank"], str(r["doc_id"]), r["similarity"]) for r in df.collect())
    whole = key(search_batch(table, queries, 25))
    assert key(search_batch(table, queries, 25, rounds=Rounds(first_rows=5, growth=2))) == whole


def test_stored_norms_serve_many_queries(spark):
    table = stretched_vectors(spark, SMALL)
    stored = with_norm(table)
    queries = queries_of(table, [0, 3])
    assert batch_rows(search_batch(stored, queries, 5, norm_column="norm")) == batch_rows(search_batch(table, queries, 5))
    # Norms that are wrong change the scores, so they are what is divided by.
    doubled = stored.withColumn("norm", F.col("norm") * 2)
    best = batch_rows(search_batch(doubled, queries, 1, norm_column="norm"))
    assert all(abs(score - 0.5) < 1e-9 for *_, score in best)
