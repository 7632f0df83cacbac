"""Merging micro-batches: nothing lost or repeated whenever it stops, and few rows read by later batches."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_article_xml import record, title, write
from vectrail.streaming import incremental
from vectrail.streaming.incremental import id_filter, ingest_new_files, merge_batches, read_ingested


def run(spark, base, source, ledger="ledger", **options):
    ingest_new_files(spark, str(base / source), str(base / "table"), str(base / ledger), **options)


def rows(spark, base):
    return sorted((r["pmid"], r["title"]) for r in read_ingested(spark, str(base / "table")).collect())


def folders(base):
    return sorted((p.parent.name, p.name) for p in (base / "table").glob("ledger=*/batch_id=*") if any(p.glob("*.parquet")))


def test_batches_become_one_folder_in_id_order(spark, tmp_path):
    for n in range(5):
        write(tmp_path / "in", f"n{n}.xml", *(record(str(n + 5 * i), title(f"t{n}")) for i in range(20)), record(f"x{n}", title("no number")))
    run(spark, tmp_path, "in", max_files_per_batch=1)
    before = rows(spark, tmp_path)
    assert len(before) == 105 and len(folders(tmp_path)) == 5
    assert merge_batches(spark, str(tmp_path / "table"), records_per_file=30) == 5
    assert rows(spark, tmp_path) == before and folders(tmp_path) == [("ledger=merged", "batch_id=1")]
    files = read_ingested(spark, str(tmp_path / "table")).where("doc_id is not null").groupBy(F.input_file_name())
    spans = sorted(files.agg(F.min("doc_id"), F.max("doc_id")).select("min(doc_id)", "max(doc_id)").collect())
    assert len(spans) >= 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert merge_batches(spark, str(tmp_path / "table")) == 0
    # Later batches go on: ids stored before the merge never change.
    write(tmp_path / "in", "n9.xml", record("7", title("changed")), record("x3", title("changed")), record("500", title("new")))
    run(spark, tmp_path, "in")
    assert rows(spark, tmp_path) == sorted([*before, ("500", "new")])
    assert merge_batches(spark, str(tmp_path / "table")) == 2
    assert rows(spark, tmp_path) == sorted([*before, ("500", "new")]) and folders(tmp_path) == [("ledger=merged", "batch_id=2")]


def two_ledgers(spark, base):
    write(base / "a", "n1.xml", record("1", title("one")), record("2", title("two")))
    write(base / "b", "n1.xml", record("2", title("again")), record("3", title("three")))
    run(spark, base, "a", "ledger-a")
    run(spark, base, "b", "ledger-b")
    return [("1", "one"), ("2", "two"), ("3", "three")]


@pytest.mark.parametrize("stop", ["write_articles", "commit", "remove_folder"])
def test_a_stopped_merge_changes_nothing_that_readers_see(spark, tmp_path, monkeypatch, stop):
    wanted = two_ledgers(spark, tmp_path)
    table = str(tmp_path / "table")
    with monkeypatch.context() as patch:
        if stop == "commit":
            done = incremental.write_articles

            def written_then_stopped(*args, **kwargs):
                done(*args, **kwargs)
                raise RuntimeError("stopped")

            patch.setattr(incremental, "write_articles", written_then_stopped)
        else:

            def stopped(*args, **kwargs):
                raise RuntimeError("stopped")

            patch.setattr(incremental, stop, stopped)
        with pytest.raises(RuntimeError, match="stopped"):
            merge_batches(spark, table)
    assert rows(spark, tmp_path) == wanted
    # A batch after the stopped merge, and a merge that ends.
    write(tmp_path / "a", "n2.xml", record("3", title("changed")), record("4", title("four")))
    run(spark, tmp_path, "a", "ledger-a")
    assert rows(spark, tmp_path) == [*wanted, ("4", "four")]
    merge_batches(spark, table)
    assert rows(spark, tmp_path) == [*wanted, ("4", "four")] and len(folders(tmp_path)) == 1


def test_a_batch_repeated_after_a_merge_adds_nothing(spark, tmp_path):
    wanted = two_ledgers(spark, tmp_path)
    merge_batches(spark, str(tmp_path / "table"))
    for commit in [p for p in (tmp_path / "ledger-a" / "commits").iterdir() if "0" in p.name]:
        commit.unlink()
    run(spark, tmp_path, "a", "ledger-a")
    assert rows(spark, tmp_path) == wanted
    merge_batches(spark, str(tmp_path / "table"))
    assert rows(spark, tmp_path) == wanted


def test_an_empty_or_missing_table_has_nothing_to_merge(spark, tmp_path):
    assert merge_batches(spark, str(tmp_path / "table")) == 0
    assert read_ingested(spark, str(tmp_path / "table")).count() == 0


def test_the_filter_holds_for_all_ids_and_cuts_at_gaps(spark):
    some = random.Random(3)
    ids = [c + some.randrange(500) for c in (-(2**63), 10**6, 10**9, 2**62) for _ in range(600)]
    table = spark.createDataFrame([(i,) for i in [*ids, 5, 10**7, 2**40]], "doc_id long")
    found = table.where(id_filter(spark.createDataFrame([(i,) for i in ids], "doc_id long")))
    # 10**7 lies in the cell of others, so it may pass; what is far from all ids does not.
    assert set(ids) <= {r[0] for r in found.collect()}
    assert not found.where(f"doc_id = {2**60}").count()
    near = spark.range(2000).selectExpr("if(id < 1000, id, id + 5000000) AS doc_id")
    wide = spark.range(0, 6_000_000, 1000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    assert wide.where(id_filter(near)).count() == 2
    assert wide.where(id_filter(spark.createDataFrame([(None,), (7000,)], "doc_id long"))).count() == 2
    assert wide.where(id_filter(near.limit(0))).count() == 0


def test_a_batch_reads_few_stored_rows_after_a_merge(spark, tmp_path):
    path = str(tmp_path / "table")
    stored = spark.range(40_000).selectExpr(
        "string(id) AS pmid", "id AS doc_id", "'t' AS title", "'' AS authors", "'a' AS abstract",
        "2000 AS publication_year", "'2000' AS publication_year_raw",
    )
    for n in range(4):
        incremental.write_articles(stored.where(f"id % 4 = {n}"), f"{path}/ledger=l/batch_id={n}", mode="overwrite")
    merge_batches(spark, path, records_per_file=4000)
    batch = spark.range(12_000, 14_000).withColumnRenamed("id", "doc_id")
    met = incremental._stored(spark, path).where(id_filter(batch)).select("pmid")
    assert met.count() == 2000
    met.write.format("noop").mode("overwrite").save()
    plan = met._jdf.queryExecution().executedPlan()
    scans = [n for n in leaves(plan) if "FileSourceScan" in n.getClass().getName()]
    met._jdf.queryExecution().toRdd().count()
    read = sum(s.metrics().apply("numOutputRows").value() for s in scans)
    assert 2000 <= read <= 12_000


def leaves(plan):
    found = plan.collectLeaves()
    for i in range(found.size()):
        node = found.apply(i)
        yield node


def test_a_merge_is_split_by_bytes_too(spark, tmp_path):
    path = str(tmp_path / "table")
    stored = spark.range(4000).selectExpr(
        "if(id % 2 = 0, '', 'new') || id AS pmid", "if(id % 2 = 0, id, NULL) AS doc_id", "'t' AS title", "'' AS authors",
        "sha2(string(id), 512) || sha2(string(-id), 512) AS abstract", "2000 AS publication_year", "'2000' AS publication_year_raw",
    )
    for n in range(2):
        incremental.write_articles(stored.where(f"id % 4 div 2 = {n}"), f"{path}/ledger=l/batch_id={n}", mode="overwrite")
    before = {tuple(r) for r in read_ingested(spark, path).collect()}
    size = sum(f.stat().st_size for f in (tmp_path / "table").rglob("*.parquet"))
    # Far fewer rows than one file may have.
    assert merge_batches(spark, path, bytes_per_file=size // 8) == 2
    merged = read_ingested(spark, path)
    files = [r["count"] for r in merged.groupBy(F.input_file_name()).count().collect()]
    assert len(files) >= 8 and max(files) < 1500
    assert {tuple(r) for r in merged.collect()} == before and merged.count() == 4000


def test_an_ingest_keeps_ids_and_no_texts(spark, tmp_path, monkeypatch):
    kept, persisted = [], incremental._persisted
    monkeypatch.setattr(incremental, "_persisted", lambda df: kept.append(df.columns) or persisted(df))
    for n in range(2):
        write(tmp_path / "in", f"n{n}.xml", *(record(str(i + n), title(f"t{n}")) for i in range(5)), record(f"x{n}", title("no number")))
    run(spark, tmp_path, "in", max_files_per_batch=1)
    assert rows(spark, tmp_path) == sorted([*((str(i), "t0") for i in range(5)), ("5", "t1"), ("x0", "no number"), ("x1", "no number")])
    assert kept and not {"title", "abstract", "authors"} & {c for columns in kept for c in columns}
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_a_batch_that_reads_other_rows_the_second_time_fails_and_is_repeated(spark, tmp_path, monkeypatch):
    write(tmp_path / "in", "n.xml", *(record(str(i), title("t")) for i in range(5)))
    with monkeypatch.context() as patch:
        rows_at = incremental._rows_at
        patch.setattr(incremental, "_rows_at", lambda *a: rows_at(*a).where("source_row % 2 = 0"))
        with pytest.raises(Exception, match="changed while they were read"):
            run(spark, tmp_path, "in")
    run(spark, tmp_path, "in")
    assert rows(spark, tmp_path) == [(str(i), "t") for i in range(5)]


@pytest.mark.parametrize("opened", [0, 1 << 18])
def test_a_merge_shuffles_no_rows_unless_files_are_many(spark, tmp_path, monkeypatch, opened):
    monkeypatch.setattr(incremental, "OPENED_FILES", opened)
    monkeypatch.setattr(incremental, "FILES_PER_CORE", 1)
    jobs, done = [], incremental.write_articles
    path = str(tmp_path / "table")
    stored = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'x', '') || id AS pmid", "if(id % 3 = 0, NULL, id - 1000) AS doc_id", "'t' AS title", "'' AS authors",
        "sha2(string(id), 512) AS abstract", "2000 AS publication_year", "'2000' AS publication_year_raw",
    )
    for n in range(3):
        done(stored.where(f"id % 9 div 3 = {n}"), f"{path}/ledger=l/batch_id={n}", mode="overwrite")
    monkeypatch.setattr(incremental, "write_articles", lambda df, *a, **k: jobs.append(df._jdf.queryExecution().executedPlan().toString()) or done(df, *a, **k))
    before = sorted(map(str, read_ingested(spark, path).collect()))
    assert merge_batches(spark, path, records_per_file=150) == 3
    assert sorted(map(str, read_ingested(spark, path).collect())) == before
    assert len(jobs) > 1 and all(("Exchange" in plan) == (opened == 0) for plan in jobs)
    files = read_ingested(spark, path).where("doc_id is not null").groupBy(F.input_file_name())
    spans = sorted(tuple(r)[1:] for r in files.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).collect())
    assert len(spans) >= 10 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and max(s[2] for s in spans) < 400
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_each_row_lies_in_one_range_of_a_merge(spark):
    odd = [(None, None), (None, ""), (None, "b"), (None, "b"), (None, "ä"), (None, "\U0001f600"), (-(2**63), "-1"), (2**63 - 1, "9"), (7, "7"), (7, "07"), (7, None)]
    table = spark.createDataFrame([*odd, *((i, str(i)) for i in range(20)), *((None, f"x{i}") for i in range(20))], "doc_id long, pmid string")
    for n in (1, 2, 5, 40):
        ranges = incremental._id_ranges(table, table.count(), n)
        assert len(ranges) <= n and (n == 1 or len(ranges) > 1)
        met = table.select(sum(F.coalesce(r, F.lit(False)).cast("int") for r in ranges).alias("n")).distinct().collect()
        assert [r[0] for r in met] == [1]


def test_articles_are_stored_compressed(spark, tmp_path):
    table = spark.range(9).selectExpr(
        "string(id) AS pmid", "id AS doc_id", "'t' AS title", "'' AS authors", "'a' AS abstract", "1 AS publication_year", "'1' AS publication_year_raw"
    )
    incremental.write_articles(table, str(tmp_path / "table"))
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "table").glob("*.parquet")]
    assert groups and {g.column(i).compression for g in groups for i in range(g.num_columns)} == {"ZSTD"}
