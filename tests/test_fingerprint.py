"""Fingerprints of tables, and ranges that belong to one."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tests.conftest import SMALL
from vectrail.operators.fingerprint import fingerprint, same_content
from vectrail.operators.quantize import (
    dimension_ranges,
    load_dimension_ranges,
    quantize_per_dimension,
    quantize_table,
    save_dimension_ranges,
    vector_range,
)
from vectrail.plans.catalog.standins import stretched_vectors
from vectrail.sources.raw_pairs import read_raw_pair, write_raw_pair
from vectrail.sources.tables import pack_vectors

SCHEMA = "doc_id bigint, doc_vector array<float>"


def mark(df):
    return tuple(fingerprint(df).head())


def test_order_split_and_storage_do_not_matter(spark):
    table = stretched_vectors(spark, SMALL)
    expected = mark(table)
    assert expected[0] == 500 and len(expected[2]) == 32
    assert mark(table.repartition(7)) == mark(table.orderBy("label")) == mark(pack_vectors(table)) == expected


@pytest.mark.parametrize("change", ["bit", "sign of zero", "id", "swap", "row less", "row twice"])
def test_any_change_is_seen(spark, change):
    rows = [(i, [float(np.float32(np.sin(i * j))) for j in range(5)]) for i in range(50)]
    other = [(i, list(v)) for i, v in rows]
    if change == "bit":
        flipped = np.array([other[7][1][2]], np.float32).view(np.uint32) ^ np.uint32(1)
        other[7][1][2] = float(flipped.view(np.float32)[0])
    elif change == "sign of zero":
        assert other[3][1][0] == 0.0
        other[3][1][0] = -0.0
    elif change == "id":
        other[9] = (90, other[9][1])
    elif change == "swap":
        other[4], other[5] = (4, other[5][1]), (5, other[4][1])
    elif change == "row less":
        other.pop()
    else:
        other.append(other[0])
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)
    assert same_content(a, a.repartition(3)).head()["matched"]
    assert not same_content(a, b).head()["matched"]


def test_a_flipped_byte_of_an_imported_file_is_found(spark, tmp_path):
    table = stretched_vectors(spark, SMALL).select("doc_id", "doc_vector")
    folders = [str(tmp_path / n) for n in ("v", "i")]
    write_raw_pair(table, *folders)
    assert tuple(same_content(table, read_raw_pair(spark, *folders, 64)).head()) == (500, 500, True)
    file = next(f for f in sorted((tmp_path / "v").glob("part*")) if f.stat().st_size)
    content = bytearray(file.read_bytes())
    content[len(content) // 2] ^= 4
    file.write_bytes(bytes(content))
    assert not same_content(table, read_raw_pair(spark, *folders, 64)).head()["matched"]


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mark(none) == (0, 0, "0" * 32)
    rows = [(None, [1.0]), (1, None), (2, []), (-(1 << 63), [1.0]), (3, [1.0, 2.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    assert mark(table)[:2] == (4, 1) and mark(table) == mark(table.repartition(3))
    assert mark(table.where("doc_id is null")) != mark(table.where("doc_id < 0"))


def test_codes_over_the_range_of_each_place(spark):
    table = stretched_vectors(spark, SMALL)
    for stored in (table.repartition(5), pack_vectors(table)):
        ranges = dimension_ranges(stored)
        found = {r["doc_id"]: r["doc_vector"] for r in quantize_per_dimension(stored, ranges).collect()}
    rows = {r["doc_id"]: np.array(r["doc_vector"], np.float32) for r in table.collect()}
    values = np.array([rows[i] for i in sorted(rows)])
    low, high = values.min(axis=0), values.max(axis=0)
    assert [tuple(r)[1:] for r in ranges.orderBy("dim").collect()] == list(zip(low.astype(float), high.astype(float)))
    expected = ((values - low) / (high - low) * np.float32(255) - np.float32(128)).astype(np.int8)
    assert np.array_equal(np.array([found[i] for i in sorted(found)], np.int8), expected)


def test_places_of_unlike_width_lose_less(spark):
    draw = np.random.default_rng(0)
    values = (draw.normal(size=(300, 4)) * [1, 0.01, 100, 0]).astype(np.float32)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)] + [(300, None)], SCHEMA)
    codes = {r["doc_id"]: r["doc_vector"] for r in quantize_per_dimension(table, dimension_ranges(table)).collect()}
    assert codes.pop(300) is None
    plain = {r["doc_id"]: r["doc_vector"] for r in quantize_table(table, vector_range(table)).collect()}
    assert len({codes[i][1] for i in codes}) > 50 and len({plain[i][1] for i in codes}) == 1
    assert {codes[i][3] for i in codes} == {-128}


def test_ranges_of_another_table_are_refused(spark, tmp_path):
    table, path = stretched_vectors(spark, SMALL), str(tmp_path / "ranges")
    save_dimension_ranges(table, path)
    assert load_dimension_ranges(table.repartition(3), path).count() == 64
    with pytest.raises(ValueError, match="not those of this table"):
        load_dimension_ranges(table.where("doc_id <> 5"), path)
    wrong = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA)
    with pytest.raises(PySparkException, match="every vector must have"):
        dimension_ranges(wrong.coalesce(1)).collect()
    with pytest.raises(PySparkException, match="NaN in a vector"):
        dimension_ranges(spark.createDataFrame([(1, [float("nan")])], SCHEMA)).collect()
