"""Continuous top k: waves of files, restarts and repeated batches."""

import shutil

from pyspark.sql import functions as F

from vectrail.operators.batch_search import search_batch
from vectrail.streaming.topk import follow_topk, read_topk


def rows(df):
    return sorted((r["query_id"], r["rank"], str(r["doc_id"]), r["similarity"]) for r in df.collect())


def test_waves_a_restart_and_a_repeated_batch(spark, tmp_path):
    table = spark.range(90).selectExpr(
        "if(id = 17, NULL, id) AS doc_id",
        "transform(sequence(1, 6), i -> float(if(id % 9 = 0, i, sin(i * id)))) AS doc_vector",
        "id % 3 AS wave",
    )
    queries = spark.createDataFrame([("b", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("a", [0.5, -1.0, 0.0, 1.0, 0.0, 2.0])], "query_id string, query_vector array<double>")
    source, checkpoint, output = (str(tmp_path / n) for n in ("in", "ledger", "out"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for wave in range(3):
        arrived = table.where(F.col("wave") <= wave).drop("wave")
        table.where(F.col("wave") == wave).drop("wave").coalesce(2).write.mode("append").parquet(source)
        follow_topk(spark, source, queries, 5, checkpoint, output)
        assert rows(read_topk(spark, queries, output)) == rows(search_batch(arrived, queries, 5))
        if wave == 1:
            # A run without new files changes nothing.
            follow_topk(spark, source, queries, 5, checkpoint, output)
            assert rows(read_topk(spark, queries, output)) == rows(search_batch(arrived, queries, 5))
    # The last batch was stored but not committed when its driver died: it runs again from its state.
    last = max(int(p.name) for p in (tmp_path / "ledger" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "ledger" / "commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / f"batch={last}", ignore_errors=True)
    follow_topk(spark, source, queries, 5, checkpoint, output)
    assert rows(read_topk(spark, queries, output)) == rows(search_batch(table.drop("wave"), queries, 5))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
