"""The k best rows of each query while files of vectors arrive."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from vectrail.functions.scorers import as_matrix, check_metric
from vectrail.functions.similarity import EPSILON
from vectrail.operators.batch_search import MAX_QUERY_BYTES, search_block
from vectrail.schema import DOC_ID, DOC_VECTOR, QUERY_ID, QUERY_VECTOR, RANK, SIMILARITY

# Rows of a state and of the output; a NULL id ranks before all others.
_HITS = "query_no int, rank int, doc_id bigint, similarity double"
_STATE = "docs array<bigint>, scores array<double>"
_SETTING = "spark.sql.streaming.stateStore.providerClass"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeepBest(StatefulProcessor):
    """Holds the k best hits of a query, and returns them anew when they change."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get()
        hits = [] if held is None else list(zip(held[0], held[1]))
        for some in rows:
            docs = some[DOC_ID].astype(object).where(some[DOC_ID].notna(), None)
            hits += zip(docs, some[SIMILARITY].tolist())
            hits = sorted(hits, key=lambda h: (-h[1], h[0] is not None, h[0] or 0))[: self.k]
        docs = [None if d is None else int(d) for d, _ in hits]
        scores = [float(s) for _, s in hits]
        if held is not None and (docs, scores) == (list(held[0]), list(held[1])):
            return
        self.best.update((docs, scores))
        yield pd.DataFrame(
            {
                "query_no": np.int32(key[0]),
                RANK: np.arange(1, len(docs) + 1, dtype=np.int32),
                DOC_ID: pd.array(docs, dtype="Int64"),
                SIMILARITY: scores,
            }
        )

    def close(self) -> None:
        pass


def follow_topk(
    spark: SparkSession,
    source: str,
    queries: DataFrame,
    k: int,
    checkpoint: str,
    output: str,
    *,
    id_column: str = DOC_ID,
    vector_column: str = DOC_VECTOR,
    metric: str = "cosine",
    clamp: str = "product",
    eps: float = EPSILON,
    on_nan: str = "error",
    max_files_per_batch: int = 1000,
) -> None:
    """Score the vector files of ``source`` that were not seen before, then stop.

    ``queries`` has ``(query_id, query_vector)`` with unique ids, at most MAX_QUERY_BYTES of vectors; they
    must be the same in every run of one checkpoint. Each task returns its k best of a micro-batch per
    query, and the state of a query holds its k best so far, so neither grows with the files. Every
    micro-batch overwrites a folder of its own below ``output``, so a batch that is repeated after a
    failure counts once. :func:`read_topk` gives the k best of all files seen.
    """
    check_metric(metric, clamp)
    table = queries.select(QUERY_ID, QUERY_VECTOR).orderBy(QUERY_ID).toArrow()
    dim = len(table.column(QUERY_VECTOR)[0])
    matrix = as_matrix(table.column(QUERY_VECTOR).combine_chunks(), dim).astype(np.float64)
    if matrix.nbytes > MAX_QUERY_BYTES:
        raise ValueError(f"the queries have {matrix.nbytes} bytes, more than {MAX_QUERY_BYTES}")
    schema = spark.read.parquet(source).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_batch).parquet(source)
    vectors = arriving.withColumnsRenamed({id_column: DOC_ID, vector_column: DOC_VECTOR})
    found, shared = search_block(vectors, matrix, k, metric, clamp, eps, on_nan)
    best = found.groupBy("query_no").transformWithStateInPandas(
        KeepBest(k), outputStructType=_HITS, outputMode="Update", timeMode="None"
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    # State of this kind needs this store; a stream takes the session's setting when it starts.
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, _PROVIDER)
    writer = best.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    run = None
    try:
        run = writer.trigger(availableNow=True).foreachBatch(store).start()
        run.awaitTermination()
    finally:
        spark.conf.set(_SETTING, before)
        if run is not None:
            run.stop()
        shared.destroy()


def read_topk(spark: SparkSession, queries: DataFrame, output: str) -> DataFrame:
    """``(query_id, doc_id, similarity, rank)``: the k best of each query over all files seen.

    A query's last batch holds all its hits, so the others are left out.
    """
    stored = spark.read.schema(T.StructType.fromDDL(f"{_HITS}, batch bigint")).parquet(output)
    last = F.max("batch").over(Window.partitionBy("query_no"))
    now = stored.withColumn("last", last).where("batch = last")
    # The driver numbers the ids as follow_topk does; both are as few as one block of queries.
    ids = [r[0] for r in queries.select(QUERY_ID).orderBy(QUERY_ID).collect()]
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query_no", T.IntegerType()), queries.schema[QUERY_ID]]))
    return now.join(F.broadcast(names), "query_no").select(QUERY_ID, DOC_ID, SIMILARITY, RANK)
