"""Exact search by bounds: over codes, and over blocks that are left out."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tests.conftest import SMALL
from vectrail.operators.blocks import describe_blocks, search_blocks, write_blocks
from vectrail.operators.quantize import vector_range
from vectrail.operators.refine import refinable_codes, score_bounds, search_refined
from vectrail.operators.search import score_table, search
from vectrail.plans.catalog.standins import first_vector, stretched_vectors
from vectrail.sources.tables import pack_vectors

METRICS = [("cosine", "product"), ("cosine", "doc"), ("dot", "product")]


def rows(df):
    return [(r["doc_id"], r["similarity"]) for r in df.collect()]


def clusters(spark, n=6000, groups=30, dim=24, seed=0, parts=6):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(groups, dim))
    points = middles[np.arange(n) % groups] + draw.normal(scale=0.05, size=(n, dim))
    points *= draw.uniform(0.1, 3, size=(n, 1))
    data = [(i, [float(x) for x in p], i % 7) for i, p in enumerate(points.astype(np.float32))]
    return spark.createDataFrame(data, "doc_id bigint, doc_vector array<float>, label int").repartition(parts), middles


@pytest.fixture(scope="module")
def clustered(spark):
    table, middles = clusters(spark)
    return table.persist(), middles


@pytest.mark.parametrize("metric,clamp", METRICS)
@pytest.mark.parametrize("k", [1, 10, 150])
def test_refined_equals_a_whole_scan(spark, metric, clamp, k):
    table = stretched_vectors(spark, SMALL).repartition(3)
    stats, q, refined = vector_range(table), first_vector(table), []
    found = search_refined(refinable_codes(table, stats), table, q, stats, k, refined=refined, metric=metric, clamp=clamp)
    assert rows(found) == rows(search(table, q, k, metric=metric, clamp=clamp))
    assert k <= refined[0] < max(60, 3 * k)


def test_bounds_hold_the_true_scores(spark):
    table = stretched_vectors(spark, SMALL)
    # A range that most vectors leave, as saved statistics of another table may be.
    stats = spark.createDataFrame([(-0.1, 0.2)], "min_val double, max_val double")
    q = first_vector(table)
    codes = refinable_codes(pack_vectors(table), stats)
    for metric, clamp in METRICS:
        ends = {r["doc_id"]: r for r in score_bounds(codes, q, stats, 10**6, metric=metric, clamp=clamp).collect()}
        for doc, score in rows(score_table(table, q, metric=metric, clamp=clamp)):
            assert ends[doc]["lower"] <= score <= ends[doc]["upper"]
        found = search_refined(codes, table, q, stats, 5, metric=metric, clamp=clamp)
        assert rows(found) == rows(search(table, q, 5, metric=metric, clamp=clamp))


def test_refined_with_odd_rows(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.1]), (None, [0.0, -1.0]), (5, None), (6, [0.0, 0.0]), (7, [1e-9, 0.0])]
    table = spark.createDataFrame(data, "doc_id bigint, doc_vector array<float>")
    stats = spark.createDataFrame([(-1.0, 1.0)], "min_val double, max_val double")
    for k in (1, 3, 50):
        found = search_refined(refinable_codes(table, stats), table, [1.0, 0.2], stats, k)
        assert rows(found) == rows(search(table, [1.0, 0.2], k))
    none = table.limit(0)
    assert rows(search_refined(refinable_codes(none, stats), none, [1.0, 0.2], stats, 3)) == []
    wild = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0])], table.schema)
    codes = refinable_codes(wild, stats)
    assert rows(search_refined(codes, wild, [1.0, 0.0], stats, 1, on_nan="drop")) == [(1, 1.0)]
    with pytest.raises(PySparkException, match="undefined similarity"):
        search_refined(codes, wild, [1.0, 0.0], stats, 1).collect()
    with pytest.raises(ValueError, match="zero query"):
        search_refined(codes, wild, [0.0, 0.0], stats, 1, clamp="doc")
    flat = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], table.schema)
    assert rows(search_refined(refinable_codes(flat, vector_range(flat)), flat, [1.0, 0.0], vector_range(flat), 1))[0][0] == 1


@pytest.mark.parametrize("metric,clamp", METRICS)
def test_blocks_are_left_out_and_no_hit_is(spark, clustered, tmp_path, metric, clamp):
    table, middles = clustered
    write_blocks(table, str(tmp_path / "t"), str(tmp_path / "s"), rows_per_block=50, centres=30)
    for query in (middles[3], -middles[5], middles[1] + middles[2]):
        read = []
        found = search_blocks(spark, str(tmp_path / "t"), str(tmp_path / "s"), query.tolist(), 10, metric=metric, clamp=clamp, blocks_read=read)
        assert rows(found) == rows(search(table, query.tolist(), 10, metric=metric, clamp=clamp))
        first, rest, total = read
        assert 0 < first + rest < total and total >= 120
    assert found.columns == ["doc_id", "label", "similarity"]


def test_block_bounds_hold_all_scores(spark, clustered, tmp_path):
    table, middles = clustered
    write_blocks(table, str(tmp_path / "t"), str(tmp_path / "s"), rows_per_block=64, centres=8)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r[0] for r in stored.select("doc_id").collect()) == list(range(6000))
    sidecar = describe_blocks(stored)
    assert sidecar.agg({"n_rows": "sum"}).head()[0] == 6000
    from vectrail.operators.blocks import block_bound

    q = (middles[0] - middles[4]).tolist()
    for metric, clamp in METRICS:
        bounds = {r[0]: r[1] for r in sidecar.select("block", block_bound(q, metric, clamp, 1e-5).alias("b")).groupBy("block").max("b").collect()}
        for r in score_table(stored, q, metric=metric, clamp=clamp).collect():
            assert r["similarity"] <= bounds[r["block"]]


def test_blocks_with_odd_rows(spark, tmp_path):
    data = [(i, [1.0, float(i % 5)]) for i in range(60)] + [(None, [1.0, 0.0]), (3, [5.0, 15.0]), (80, None), (81, [0.0, 0.0]), (82, [1e-9, 1e-9])]
    table = spark.createDataFrame(data, "doc_id bigint, doc_vector array<float>")
    write_blocks(table, str(tmp_path / "t"), str(tmp_path / "s"), rows_per_block=4, centres=4)
    for q in ([1.0, 3.0], [-1.0, -1.0], [0.0, 0.0]):
        for k in (1, 7, 500):
            found = search_blocks(spark, str(tmp_path / "t"), str(tmp_path / "s"), q, k)
            assert rows(found) == rows(search(table, q, k))


def test_a_third_of_all_rows_in_one_place(spark, tmp_path):
    table = spark.range(0, 3000, 1, 4).selectExpr(
        "id AS doc_id", "transform(sequence(1, 8), i -> float(if(id % 3 = 0, i, sin(i * id)))) AS doc_vector"
    )
    write_blocks(table, str(tmp_path / "t"), str(tmp_path / "s"), rows_per_block=100, centres=8)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("block").count().collect()]
    assert max(sizes) <= 100
    q = [float(i) for i in range(1, 9)]
    assert rows(search_blocks(spark, str(tmp_path / "t"), str(tmp_path / "s"), q, 5)) == rows(search(table, q, 5))
