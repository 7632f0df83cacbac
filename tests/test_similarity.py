"""Scores against NumPy, and the edge cases of both engines."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vectrail.functions import similarity
from vectrail.operators.profile import check_dim, with_norm
from vectrail.operators.search import score_table, search
from vectrail.schema import VECTORS
from vectrail.sources.tables import pack_vectors, read_vectors, write_vectors

ENGINES = ["arrow", "expr"]


def table(spark, vectors, kind="array<float>"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "doc_id bigint, doc_vector array<double>")
    return df.withColumn("doc_vector", F.col("doc_vector").cast(kind))


def scores(df):
    return {r[0]: r[1] for r in df.select("doc_id", "similarity").collect()}


def expected(matrix, q, metric, clamp, eps=1e-5):
    matrix = np.asarray(matrix, np.float32).astype(float)
    dots = matrix @ q
    if metric == "dot":
        return dots
    norms, norm = np.linalg.norm(matrix, axis=1), np.linalg.norm(q)
    if clamp == "product":
        return dots / np.maximum(norms * norm, eps)
    return dots / norm / np.maximum(norms, eps)


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("metric,clamp", [("cosine", "product"), ("cosine", "doc"), ("dot", "product")])
def test_scores_equal_numpy(spark, engine, metric, clamp):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(50, 7)) * rng.uniform(1e-8, 10, size=(50, 1))
    matrix[3] = 0
    q = rng.normal(size=7)
    df = table(spark, matrix.tolist())
    found = scores(score_table(df, q.tolist(), metric=metric, clamp=clamp, engine=engine))
    assert np.allclose([found[i] for i in range(50)], expected(matrix, q, metric, clamp), atol=1e-11)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(
        st.lists(st.floats(-100, 100, width=32), min_size=3, max_size=3), min_size=1, max_size=8
    ),
    query=st.lists(st.floats(-100, 100, width=32), min_size=3, max_size=3),
)
def test_engines_agree(spark, data, query):
    df = table(spark, data)
    one, other = (scores(score_table(df, query, engine=e)) for e in ENGINES)
    assert one.keys() == other.keys()
    assert all(math.isclose(one[i], other[i], abs_tol=2e-12) for i in one)


def test_cosine_does_not_depend_on_length(spark):
    df = table(spark, [[1.0, 2.0, 3.0], [4.0, 8.0, 12.0]])
    found = scores(score_table(df, [3.0, 2.0, 1.0]))
    assert math.isclose(found[0], found[1], abs_tol=1e-12)


@pytest.mark.parametrize("engine", ENGINES)
def test_zero_query(spark, engine):
    df = table(spark, [[1.0, 2.0]])
    assert scores(score_table(df, [0.0, 0.0], engine=engine)) == {0: 0.0}
    with pytest.raises(ValueError, match="zero query"):
        score_table(df, [0.0, 0.0], clamp="doc", engine=engine)


@pytest.mark.parametrize("engine", ENGINES)
def test_nan_is_an_error_or_dropped(spark, engine):
    df = table(spark, [[1.0, 2.0], [float("nan"), 1.0], [2.0, 1.0]])
    with pytest.raises(PySparkException, match="undefined similarity"):
        score_table(df, [1.0, 0.0], engine=engine).collect()
    assert scores(score_table(df, [1.0, 0.0], on_nan="drop", engine=engine)).keys() == {0, 2}


@pytest.mark.parametrize("engine", ENGINES)
def test_wrong_dimension_fails(spark, engine):
    df = table(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]])
    with pytest.raises(PySparkException):
        score_table(df, [1.0, 0.0], engine=engine).collect()
    with pytest.raises(ValueError, match="one dimension"):
        check_dim(df)


@pytest.mark.parametrize("engine", ENGINES)
def test_missing_vectors_are_left_out(spark, engine):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], VECTORS)
    assert scores(score_table(df, [1.0, 0.0], engine=engine)) == {1: 1.0}


@pytest.mark.parametrize("engine", ENGINES)
def test_stored_norms_give_the_same_scores(spark, engine):
    df = table(spark, [[3.0, 4.0], [0.0, 0.0], [5.0, 12.0]])
    plain = scores(score_table(df, [1.0, 1.0], engine=engine))
    stored = score_table(with_norm(df), [1.0, 1.0], norm_column="norm", engine=engine)
    assert stored.columns == ["doc_id", "similarity"]
    assert scores(stored) == plain


def test_int8_and_packed_vectors(spark):
    codes = table(spark, [[1, 2, -3], [127, -128, 0], [0, 0, 0]], "array<tinyint>")
    floats = table(spark, [[1, 2, -3], [127, -128, 0], [0, 0, 0]])
    query = [0.5, -1.0, 2.0]
    results = [scores(search(t, query, 5)) for t in (codes, floats, pack_vectors(codes), pack_vectors(floats))]
    assert all(r == results[0] for r in results)


def test_packed_floats_are_not_taken_for_codes(spark):
    packed = pack_vectors(table(spark, [[1.0, 2.0]]))
    with pytest.raises(PySparkException, match="8 values, found 2 to 2"):
        score_table(packed, [1.0] * 8).collect()


def test_stored_codes_keep_their_element_type(spark, tmp_path):
    codes = table(spark, [[1, 2, -3, 4], [5, 0, 0, 1]], "array<tinyint>")
    write_vectors(codes, str(tmp_path / "codes"), packed=True)
    stored = read_vectors(spark, str(tmp_path / "codes"))
    query = [1.0, 0.0, 2.0, 0.5]
    assert scores(score_table(stored, query)) == scores(score_table(codes, query))


def test_columns_on_both_sides(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [0.0, 0.0])],
        "v array<float>, q array<float>",
    )
    v, q = F.col("v"), F.col("q")
    rows = df.select(
        similarity.dot(v, q),
        similarity.l2_norm(v),
        similarity.l2_normalize(v),
        similarity.cosine(v, q),
        similarity.cosine(v, q, "doc"),
    ).collect()
    assert tuple(rows[0][:2]) == (24.0, 5.0) and rows[0][2] == pytest.approx([0.6, 0.8])
    assert rows[0][3] == pytest.approx(0.96) and rows[0][4] == pytest.approx(0.96)
    assert rows[1][2] is None and rows[1][3] == 0 and rows[1][4] == 0
    assert rows[2][3] == 0 and rows[2][4] is None
