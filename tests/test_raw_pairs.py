"""Headerless binary pairs."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from vectrail.operators.profile import pair_counts
from vectrail.sources import raw_pairs
from vectrail.sources.raw_pairs import pair_files, read_raw_pair, write_raw_pair


def files(folder, ids, vectors, name="part"):
    folder.mkdir(exist_ok=True)
    (folder / "ids").mkdir(exist_ok=True)
    (folder / "vectors").mkdir(exist_ok=True)
    np.asarray(ids, "<i8").tofile(folder / "ids" / f"{name}.i64")
    np.asarray(vectors, "<f4").tofile(folder / "vectors" / f"{name}.f32")
    return str(folder / "vectors"), str(folder / "ids")


def test_rows_pair_by_position(spark, tmp_path):
    vectors = np.random.default_rng(0).normal(size=(10, 4)).astype("f4")
    ids = np.arange(10)[::-1] * 100 - 300
    folders = files(tmp_path / "p", ids, vectors)
    for v, i in (folders, (f"{folders[0]}/part.f32", f"{folders[1]}/part.i64")):
        rows = dict(read_raw_pair(spark, v, i, 4).collect())
        assert rows == {int(k): vectors[n].tolist() for n, k in enumerate(ids)}


def test_folders_of_pairs_and_writing(spark, tmp_path):
    rows = [(i, [float(i), i / 3, -1.0]) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id bigint, doc_vector array<float>").repartition(6)
    folders = [str(tmp_path / n) for n in ("v", "i")]
    written = write_raw_pair(table, *folders)
    assert written.agg({"n_rows": "sum"}).head()[0] == 2000
    back = read_raw_pair(spark, *folders, 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_rewriting_replaces_all_files(spark, tmp_path):
    table = spark.range(500).selectExpr("id AS doc_id", "array(float(id), 1.0f) AS doc_vector")
    folders = [str(tmp_path / n) for n in ("v", "i")]
    write_raw_pair(table.repartition(4), *folders)
    with pytest.raises(ValueError, match="not empty"):
        write_raw_pair(table.coalesce(1), *folders)
    write_raw_pair(table.coalesce(1), *folders, mode="overwrite")
    assert read_raw_pair(spark, *folders, 2).count() == 500


def test_folders_with_one_file_each_pair_by_name(spark, tmp_path):
    folders = files(tmp_path / "p", range(3), np.zeros((3, 4)))
    (tmp_path / "p" / "ids" / "part.i64").rename(tmp_path / "p" / "ids" / "other.i64")
    with pytest.raises(ValueError, match="differ in number"):
        read_raw_pair(spark, *folders, 4)


def test_ranges_and_pieces_cover_every_row(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(raw_pairs, "RANGE_BYTES", 7 * 16)
    monkeypatch.setattr(raw_pairs, "PIECE_BYTES", 3 * 16)
    vectors = np.random.default_rng(1).normal(size=(50, 4)).astype("f4")
    table = read_raw_pair(spark, *files(tmp_path / "p", range(50), vectors), 4)
    assert dict(table.collect()) == {n: v.tolist() for n, v in enumerate(vectors)}
    table.explain()
    # Lists of files are joined, vectors are not.
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "Scan ExistingRDD" not in plan


def test_unequal_counts_fail(spark, tmp_path):
    folders = files(tmp_path / "p", range(9), np.zeros((10, 4)))
    with pytest.raises(ValueError, match="differ in number"):
        read_raw_pair(spark, *folders, 4)
    row = pair_files(spark, *folders, 4).head()
    assert (row["n_rows"], row["n_ids"]) == (10, 9)
    counts = pair_counts(spark.range(9), spark.range(10)).head()
    assert tuple(counts) == (9, 10, False)


def test_partial_records_fail(spark, tmp_path):
    folders = files(tmp_path / "p", range(10), np.zeros(4 * 10 + 2))
    with pytest.raises(PySparkException, match="partial record"):
        read_raw_pair(spark, *folders, 4)


def test_missing_partner_fails(spark, tmp_path):
    files(tmp_path / "p", range(10), np.zeros((10, 4)), "a")
    folders = files(tmp_path / "p", range(10), np.zeros((10, 4)), "b")
    (tmp_path / "p" / "ids" / "c.i64").write_bytes(bytes(8))
    with pytest.raises(ValueError, match="differ in number"):
        read_raw_pair(spark, *folders, 4)
