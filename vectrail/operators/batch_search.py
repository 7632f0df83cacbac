"""Exact top-k search for many query vectors in one scan of the table, or in rounds over parts of it."""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectrail.functions.packing import packed_element
from vectrail.functions.scorers import as_matrix, check_metric, prepare_queries, similarities
from vectrail.functions.similarity import EPSILON, SCORE_DECIMALS
from vectrail.schema import DOC_ID, DOC_VECTOR, QUERY_ID, QUERY_VECTOR, RANK, SIMILARITY
from vectrail.scratch import new_path, written

# Query vectors sent to every executor at a time; more queries are searched in several scans.
MAX_QUERY_BYTES = 64 << 20
# Stands for a NULL id within a task.
_NO_ID = np.iinfo(np.int64).min
# Bytes of a hit in a task: query, id and score, and their sorted copies.
_HIT_BYTES = 72
# Scores held at a time by one task, as a matrix of rows by queries.
_MAX_SCORES = 4 << 20
# Each query's hits are first merged in this many groups, then across them.
MERGE_GROUPS = 16
# Rows fall into this many equal shares by hash, of which a round takes a range.
_SHARES = 1 << 30


class Rounds(NamedTuple):
    """A search of parts of the table one after another, each with what the earlier ones found.

    The first part has about ``first_rows`` rows and each further one makes the rows seen
    ``growth`` times as many. A later round returns only hits that beat the k-th best so far of
    their query: about ``(growth - 1) * k`` a query, however many tasks there are. Every row is
    scored once. ``by='row'`` deals rows by their id and reads the table in each round; ``by='file'``
    deals whole files of a table read from files, so that each is read once. Rows of one id, or of
    one file, make one part; if they are most of the table, more hits are returned, none is lost.
    """

    first_rows: int = 1 << 17
    growth: int = 3
    by: str = "row"

    def parts(self, rows: int) -> list[tuple[int, int]]:
        """Ranges of shares that follow each other and cover all."""
        if self.growth < 2 or self.first_rows < 1 or self.by not in ("row", "file"):
            raise ValueError("rounds need growth >= 2, first_rows >= 1 and by 'row' or 'file'")
        ends = [_SHARES]
        while rows * ends[0] // _SHARES > self.first_rows:
            ends.insert(0, ends[0] // self.growth)
        return list(zip([0, *ends], ends))

    def share(self) -> Column:
        key = F.col(DOC_ID) if self.by == "row" else F.col("_metadata.file_path")
        return F.pmod(F.xxhash64(key), F.lit(_SHARES))

_FOUND = T.StructType(
    [
        T.StructField("query_no", T.IntegerType()),
        T.StructField(DOC_ID, T.LongType()),
        T.StructField(SIMILARITY, T.DoubleType()),
    ]
)


class _Best:
    """The k best hits per query seen so far by one task."""

    def __init__(self, bar_score: np.ndarray, bar_doc: np.ndarray, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)
        self.score = np.empty(0)
        # A new hit must beat the k-th one, which is known once a query has k hits.
        self.bar_score, self.bar_doc = bar_score.copy(), bar_doc.copy()

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        bar = self.bar_score
        if len(docs) > self.k and np.isneginf(bar).any():
            place = len(docs) - self.k
            bar = np.maximum(bar, np.partition(scores, place, axis=0)[place])
        # Only what may reach the bar is rounded and compared exactly.
        row, query = np.nonzero(scores >= bar - 10.0**-SCORE_DECIMALS)
        score = np.round(scores[row, query], SCORE_DECIMALS)
        doc = docs[row]
        least = self.bar_score[query]
        kept = (score > least) | ((score == least) & (doc <= self.bar_doc[query]))
        query = np.concatenate([self.query, query[kept]])
        doc = np.concatenate([self.doc, doc[kept]])
        score = np.concatenate([self.score, score[kept]])
        order = np.lexsort((doc, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        kept = place < self.k
        self.query, self.doc, self.score = query[kept], doc[order][kept], score[order][kept]
        last = place[kept] == self.k - 1
        self.bar_score[self.query[last]] = self.score[last]
        self.bar_doc[self.query[last]] = self.doc[last]


def search_block(
    vectors: DataFrame,
    matrix: np.ndarray,
    k: int,
    metric: str,
    clamp: str,
    eps: float,
    on_nan: str,
    norm_column: str | None = None,
    bars: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[DataFrame, object]:
    """Every task's k best hits per query of one block, and the broadcast they need.

    ``bars`` are score and id of a hit per query that others must beat.
    """
    if bars is None:
        bars = np.full(len(matrix), -np.inf), np.full(len(matrix), np.iinfo(np.int64).max)
    shared = vectors.sparkSession.sparkContext.broadcast((matrix, *bars))
    element = packed_element(vectors)

    def local_best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, *bars = shared.value
        queries = prepare_queries(vectors, metric, clamp, eps)
        dim, count = queries.columns.shape
        step = max(1, _MAX_SCORES // count)
        best = _Best(*bars, k)
        for batch in batches:
            rows = as_matrix(batch.column(1), dim, element)
            norms = batch.column(2).to_numpy(zero_copy_only=False) if norm_column else None
            # A NULL id ranks before all others, as it does in a search for one query.
            docs = pc.fill_null(batch.column(0), _NO_ID).to_numpy()
            for start in range(0, len(docs), step):
                known = None if norms is None else norms[start : start + step]
                scores = similarities(rows[start : start + step], queries, known)
                if np.isnan(scores.sum()):
                    undefined = np.isnan(scores)
                    if on_nan == "error" and undefined.any():
                        raise ValueError("undefined similarity")
                    scores[undefined] = -np.inf
                best.add(docs[start : start + step], scores)
        real = best.score > -np.inf
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(best.query[real].astype(np.int32)),
                pa.array(best.doc[real], mask=best.doc[real] == _NO_ID),
                pa.array(best.score[real]),
            ],
            _FOUND.names,
        )

    stored = [F.col(norm_column).cast("double")] if norm_column else []
    present = vectors.select(F.col(DOC_ID).cast("bigint"), DOC_VECTOR, *stored).where(
        F.col(DOC_VECTOR).isNotNull()
    )
    return present.mapInArrow(local_best, _FOUND), shared


def _bars(hits: DataFrame, queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and id of each query's k-th hit; the block of queries bounds their number."""
    score, doc = np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)
    table = hits.where(F.col(RANK) == k).select("query_no", DOC_ID, SIMILARITY).toArrow()
    at = table.column("query_no").to_numpy()
    doc[at] = pc.fill_null(table.column(DOC_ID), _NO_ID).to_numpy()
    score[at] = table.column(SIMILARITY).to_numpy()
    return score, doc


def _in_rounds(
    vectors: DataFrame,
    matrix: np.ndarray,
    k: int,
    rounds: Rounds,
    parts: list[tuple[int, int]],
    merge_groups: int,
    returned: list[int] | None,
    **scoring,
) -> DataFrame:
    """The k best hits per query of one block of queries, ranked, part after part of the table."""
    best, bars = None, None
    for low, high in parts:
        share = rounds.share()
        part = vectors if len(parts) == 1 else vectors.where((share >= low) & (share < high))
        found, shared = search_block(part, matrix, k, **scoring, bars=bars)
        hits = Observation()
        found = found.observe(hits, F.count("*").alias("n"))
        if best is not None:
            found = found.unionByName(best.drop(RANK))
        best = written(_merge(found, k, merge_groups), "round")
        shared.destroy()
        if returned is not None:
            returned.append(hits.get["n"])
        if high < _SHARES:
            bars = _bars(best, len(matrix), k)
    return best


def _query_profile(queries: DataFrame) -> tuple[int, int]:
    """Number and dimension of the queries, after checking that all have one dimension."""
    size = F.array_size(QUERY_VECTOR)
    count, sized, low, high = queries.agg(
        F.count("*"), F.count(size), F.min(size), F.max(size)
    ).head()
    if count and (sized != count or low != high or low <= 0):
        raise ValueError(f"query vectors must have one dimension, found {low} to {high}")
    return count, high


def _check_ids(n_distinct: int, count: int) -> None:
    if n_distinct != count:
        raise ValueError("query ids must be unique and not NULL")


def _merge(found: DataFrame, k: int, merge_groups: int) -> DataFrame:
    """The k best of all tasks' hits per query, ranked."""

    def best(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(SIMILARITY), F.asc(DOC_ID))
        return df.withColumn(RANK, F.row_number().over(order)).where(F.col(RANK) <= k)

    if merge_groups > 1:
        grouped = found.withColumn("merge_group", F.expr(f"pmod(hash({DOC_ID}), {merge_groups})"))
        found = best(grouped, "query_no", "merge_group").drop("merge_group", RANK)
    return best(found, "query_no")


def search_batch(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    metric: str = "cosine",
    clamp: str = "product",
    eps: float = EPSILON,
    on_nan: str = "error",
    norm_column: str | None = None,
    max_query_bytes: int = MAX_QUERY_BYTES,
    merge_groups: int = MERGE_GROUPS,
    rounds: Rounds | None = None,
    returned: list[int] | None = None,
) -> DataFrame:
    """The k most similar rows of ``vectors`` for each row of ``queries``, with their ranks.

    ``queries`` has ``(query_id, query_vector)``, ids unique, and is evaluated once. Query vectors
    go to the executors in blocks of at most ``max_query_bytes``, with the hits that a task holds of
    them. Each task scores its rows against the block as a matrix product and returns only its own k
    best per query, so no row meets a query in a join. The blocks are searched one after another
    before this returns, each in one scan of ``vectors``, or in ``rounds`` over parts of it that
    return fewer hits. Their hits are written below the shared folder, so that the driver holds one
    block at a time. ``norm_column`` names stored lengths of the vectors. ``returned`` takes the
    number of hits that each round's tasks return.
    """
    check_metric(metric, clamp)
    if on_nan not in ("error", "drop"):
        raise ValueError(f"on_nan must be 'error' or 'drop', not {on_nan!r}")
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    queries = written(queries.select(QUERY_ID, QUERY_VECTOR), "queries")
    count, dim = _query_profile(queries)
    key_type = queries.schema[QUERY_ID].dataType
    result_type = T.StructType(
        [T.StructField(QUERY_ID, key_type), *_FOUND.fields[1:], T.StructField(RANK, T.IntegerType())]
    )
    if not count:
        return spark.createDataFrame([], result_type)
    # A task holds k hits of each query beside its vector.
    blocks = -(-count * (dim * 8 + k * _HIT_BYTES) // max_query_bytes)
    bounds = [(0, count - 1)]
    if blocks > 1:
        _check_ids(queries.agg(F.countDistinct(QUERY_ID)).head()[0], count)
        queries, bounds = _blocks_of_queries(queries, count, blocks)
    rounds = rounds or Rounds(first_rows=_SHARES)
    parts = [(0, _SHARES)] if rounds.first_rows >= _SHARES else rounds.parts(vectors.count())
    path = new_path(spark, "batch-search")
    for low, high in bounds:
        block = queries if blocks <= 1 else queries.where(F.col("place").between(low, high))
        table = block.select(QUERY_ID, QUERY_VECTOR).toArrow()
        ids = table.column(QUERY_ID).to_pylist()
        _check_ids(len(set(ids) - {None}), len(ids))
        matrix = as_matrix(table.column(QUERY_VECTOR).combine_chunks(), dim).astype(np.float64)
        if not np.isfinite(matrix).all():
            raise ValueError("query vectors must be finite")
        prepare_queries(matrix, metric, clamp, eps)
        scoring = {"metric": metric, "clamp": clamp, "eps": eps, "on_nan": on_nan, "norm_column": norm_column}
        hits = _in_rounds(vectors, matrix, k, rounds, parts, merge_groups, returned, **scoring)
        named = _with_query_ids(spark, hits, ids, key_type).select(result_type.names)
        named.write.mode("append").parquet(path)
    return spark.read.schema(result_type).parquet(path)


def _with_query_ids(
    spark: SparkSession, hits: DataFrame, ids: list, key_type: T.DataType
) -> DataFrame:
    """Replace query numbers by ids; the ids of one block fit a broadcast as its vectors do."""
    names = spark.createDataFrame(
        [(no, key) for no, key in enumerate(ids)],
        T.StructType([T.StructField("query_no", T.IntegerType()), T.StructField(QUERY_ID, key_type)]),
    )
    return hits.join(F.broadcast(names), "query_no")


def _blocks_of_queries(
    queries: DataFrame, count: int, blocks: int
) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Number the queries in id order and give the number ranges of equal blocks.

    The queries are range-partitioned, sorted and written once with their partition, so that the
    numbering is a count per partition and the blocks are exact whatever the ids look like.
    """
    spark = queries.sparkSession
    path = new_path(spark, "query-blocks")
    (
        queries.repartitionByRange(blocks, QUERY_ID)
        .sortWithinPartitions(QUERY_ID)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mono"))
        .write.parquet(path)
    )
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("part").agg(F.count("*").alias("n"), F.min("mono").alias("base")).collect()
    starts, total = [], 0
    for part, n, base in sorted(map(tuple, sizes)):
        starts.append((part, base, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, base bigint, start bigint")
    numbered = stored.join(F.broadcast(offsets), "part").select(
        QUERY_ID, QUERY_VECTOR, (F.col("start") + F.col("mono") - F.col("base")).alias("place")
    )
    size = -(-count // blocks)
    return numbered, [(low, low + size - 1) for low in range(0, count, size)]
