"""Int8 codes against NumPy, and range statistics."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tests.conftest import SMALL
from vectrail.functions.packing import unpack_codes, unpack_floats
from vectrail.operators.profile import check_dim, table_profile, with_norm
from vectrail.operators.quantize import quantize_table, range_stats, vector_range
from vectrail.operators.search import search
from vectrail.plans.catalog.standins import stretched_vectors
from vectrail.schema import RANGE_STATS, VECTORS
from vectrail.sources.tables import pack_vectors

ENGINES = ["arrow", "expr"]


def stats(spark, low, high):
    return spark.createDataFrame([(low, high)], RANGE_STATS)


def codes(df):
    return {r["doc_id"]: r["doc_vector"] for r in df.collect()}


@pytest.mark.parametrize("engine", ENGINES)
def test_codes_equal_numpy(spark, engine):
    table = stretched_vectors(spark, SMALL)
    rows = {r["doc_id"]: np.array(r["doc_vector"], np.float32) for r in table.collect()}
    matrix = np.array(list(rows.values()))
    low, high = float(matrix.min()), float(matrix.max())
    assert tuple(vector_range(table).head()) == (low, high)
    found = codes(quantize_table(table, vector_range(table), engine=engine))
    step = (high - low) / 255
    for doc, values in rows.items():
        wanted = ((values - np.float32(low)) / np.float32(high - low) * np.float32(255) - np.float32(128)).astype(np.int8)
        assert found[doc] == wanted.tolist()
        back = (np.array(found[doc]) + 128.0) * step + low
        assert np.abs(back - values).max() <= step * 1.001


@pytest.mark.parametrize("engine", ENGINES)
def test_values_beyond_the_range_and_constant_tables(spark, engine):
    table = spark.createDataFrame([(1, [-5.0, 0.0, 0.5, 1.0, 9.0]), (2, None)], VECTORS)
    assert codes(quantize_table(table, stats(spark, 0.0, 1.0), engine)) == {1: [-128, -128, 0, 127, 127], 2: None}
    assert codes(quantize_table(table, stats(spark, 2.0, 2.0), engine)) == {1: [-128] * 5, 2: None}


def test_nan_has_no_range(spark):
    table = spark.createDataFrame([(1, [1.0, float("nan")])], VECTORS)
    with pytest.raises(PySparkException, match="NaN"):
        vector_range(table).collect()
    with pytest.raises(ValueError, match="no vectors"):
        quantize_table(table, vector_range(table.limit(0)))


def test_saved_range_is_reused_until_recomputed(spark, tmp_path):
    path = str(tmp_path / "range")
    one = spark.createDataFrame([(1, [0.0, 1.0])], VECTORS)
    two = spark.createDataFrame([(1, [-3.0, 4.0])], VECTORS)
    assert tuple(range_stats(one, path).head()) == (0.0, 1.0)
    assert tuple(range_stats(two, path).head()) == (0.0, 1.0)
    assert tuple(range_stats(two, path, "recompute").head()) == (-3.0, 4.0)


def test_packing_there_and_back(spark):
    rows = [(1, [0.5, -1.0]), (2, None), (3, []), (4, [3.0])]
    table = spark.createDataFrame(rows, VECTORS)
    packed = pack_vectors(table)
    assert dict(packed.select("doc_id", unpack_floats("doc_vector")).collect()) == dict(rows)
    small = table.withColumn("doc_vector", table.doc_vector.cast("array<tinyint>"))
    back = pack_vectors(small).select("doc_id", unpack_codes("doc_vector"))
    assert dict(back.collect()) == {1: [0, -1], 2: None, 3: [], 4: [3]}


def test_packed_tables_are_taken_everywhere(spark):
    table = stretched_vectors(spark, SMALL)
    packed = pack_vectors(table)
    assert vector_range(packed).head() == vector_range(table).head()
    for engine in ENGINES:
        found = codes(quantize_table(packed, vector_range(table), engine=engine))
        assert found == codes(quantize_table(table, vector_range(table), engine=engine))
    assert check_dim(packed) == 64
    assert table_profile(packed).head() == table_profile(table).head()
    norms = lambda t: sorted(map(tuple, with_norm(t).select("doc_id", "norm").collect()))
    assert norms(packed) == norms(table)
    one = lambda t: [tuple(r) for r in search(t, [1.0] * 64, 5, engine="expr").collect()]
    assert one(packed) == one(table)
