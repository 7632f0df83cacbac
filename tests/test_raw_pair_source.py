"""The raw pair format: reading ranges and columns, and writes that end or do not."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vectrail.sources.raw_pair_source import MANIFEST, NAME, register, remove_strays

SCHEMA = "doc_id bigint, doc_vector array<float>"


@pytest.fixture(autouse=True)
def registered(spark):
    register(spark)


def table(spark, n, start=0, parts=4):
    return spark.range(start, start + n, 1, parts).selectExpr(
        "id AS doc_id", "array(float(id), float(id / 3), -1f) AS doc_vector"
    )


def store(df, path, mode="append", dim=3):
    df.write.format(NAME).option("path", path).option("dim", dim).mode(mode).save()


def load(spark, path, **options):
    return spark.read.format(NAME).options(path=path, **options).load()


def rows(df):
    return sorted((r[0], tuple(r[1])) for r in df.collect())


def test_written_tables_read_back_in_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    store(table(spark, 1000), path)
    for options in ({}, {"range_bytes": 7 * 12}):
        assert rows(load(spark, path, **options)) == rows(table(spark, 1000))
    assert load(spark, path, range_bytes=7 * 12).rdd.getNumPartitions() >= 140
    store(table(spark, 10, 5000), path)
    assert load(spark, path).count() == 1010
    store(table(spark, 5), path, mode="overwrite")
    assert rows(load(spark, path)) == rows(table(spark, 5))
    # What the new table replaced is gone from the folder too.
    assert len(list((tmp_path / "t" / "ids").iterdir())) == len(json.loads((tmp_path / "t" / MANIFEST).read_text())["parts"])


def test_ids_alone_and_filters_read_no_other_vectors(spark, tmp_path):
    path = str(tmp_path / "t")
    store(table(spark, 900), path)
    ids = spark.read.format(NAME).schema("doc_id bigint").option("path", path).load()
    found = load(spark, path).where("doc_id in (3, 870) or doc_id = 5")
    for vectors in (tmp_path / "t" / "vectors").iterdir():
        kept = vectors.read_bytes()
        vectors.write_bytes(b"")
        assert sorted(r[0] for r in ids.collect()) == list(range(900))
        # Ids that no row has are answered without the vectors.
        assert load(spark, path).where("doc_id = 5000").count() == 0
        vectors.write_bytes(kept)
    assert sorted(r[0] for r in found.collect()) == [3, 5, 870]
    for condition in ("doc_id = 7", "doc_id in (7, 8, 5000)", "doc_id > 890", "doc_id >= 890", "doc_id < 4 and doc_id <> 2", "doc_id <= 4", "size(doc_vector) = 3 and doc_id = 1"):
        expected = rows(table(spark, 900).where(condition))
        assert rows(load(spark, path).where(condition)) == expected and expected


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = table(spark, 100).withColumn(
        "doc_vector", F.when(F.col("doc_id") == 99, F.raise_error(F.lit("killed"))).otherwise(F.col("doc_vector"))
    )
    with pytest.raises(PySparkException, match="killed"):
        store(bad, path)
    with pytest.raises(PySparkException, match="no finished table"):
        load(spark, path).count()
    store(table(spark, 10), path)
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException, match="killed"):
            store(bad, path, mode)
        assert rows(load(spark, path)) == rows(table(spark, 10))
    # Tasks that were killed may leave files, which nothing reads.
    remove_strays(path)
    assert rows(load(spark, path)) == rows(table(spark, 10)) and remove_strays(path) == 0
    assert len(list((tmp_path / "t" / "vectors").iterdir())) == 4


def test_a_killed_driver_leaves_nothing_to_read(spark, tmp_path):
    # All files of a write are there, its manifest is not.
    path = str(tmp_path / "t")
    store(table(spark, 10), path)
    (tmp_path / "t" / MANIFEST).rename(tmp_path / "t" / f".{MANIFEST}-draft")
    with pytest.raises(PySparkException, match="no finished table"):
        load(spark, path).count()


@pytest.mark.parametrize("vector", ["array(1f, 2f)", "CAST(NULL AS ARRAY<FLOAT>)"])
def test_wrong_vectors_are_refused(spark, tmp_path, vector):
    bad = spark.range(4).selectExpr("id AS doc_id", f"{vector} AS doc_vector")
    with pytest.raises(PySparkException, match="vector"):
        store(bad, str(tmp_path / "t"))
    mixed = spark.range(4).selectExpr("id AS doc_id", "if(id % 2 = 0, array(1f, 2f), array(1f, 2f, 3f, 4f)) AS doc_vector")
    with pytest.raises(PySparkException, match="3 values"):
        store(mixed.coalesce(1), str(tmp_path / "t"))


def test_foreign_folders_pair_by_name(spark, tmp_path):
    for name, n in (("a", 10), ("b", 3)):
        for folder, values in (("ids", np.arange(n, dtype="<i8")), ("vectors", np.arange(4 * n, dtype="<f4"))):
            (tmp_path / folder).mkdir(exist_ok=True)
            values.tofile(tmp_path / folder / f"{name}.{folder}")
    options = {"ids_path": str(tmp_path / "ids"), "vectors_path": str(tmp_path / "vectors"), "dim": 4}
    found = spark.read.format(NAME).options(**options).load()
    assert found.count() == 13 and found.where("doc_id = 9").first()["doc_vector"] == [36.0, 37.0, 38.0, 39.0]
    np.arange(9, dtype="<i8").tofile(tmp_path / "ids" / "a.ids")
    with pytest.raises(PySparkException, match="differ in number"):
        spark.read.format(NAME).options(**options).load().count()
    (tmp_path / "ids" / "a.ids").write_bytes(bytes(75))
    with pytest.raises(PySparkException, match="partial record"):
        spark.read.format(NAME).options(**options).load().count()


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    store(table(spark, 0), path)
    assert load(spark, path).collect() == []
