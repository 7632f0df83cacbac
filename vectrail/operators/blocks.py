"""Search that leaves out blocks of a table by a bound on their scores.

The table is stored by similarity: vectors near the same centres lie together. A block is a range of
rows of one file, known by its number. The sidecar holds a centre of each block's directions, the
radius around it and the range of lengths, from which Cauchy-Schwarz bounds the score of every row
that the block holds. Blocks are read from the highest bound on, and those below the k-th best score
found are never read.
"""

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from vectrail.functions import similarity
from vectrail.functions.packing import packed_element, with_arrays
from vectrail.functions.scorers import as_matrix, check_metric
from vectrail.operators.lookup import one_of
from vectrail.operators.profile import check_dim
from vectrail.operators.search import score_table, top_k
from vectrail.schema import DOC_ID, DOC_VECTOR, SIMILARITY
from vectrail.scratch import written
from vectrail.sources.tables import write_vectors

BLOCK = "block"
_SIDECAR = T.StructType(
    [
        T.StructField(BLOCK, T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("centre", T.ArrayType(T.DoubleType())),
        T.StructField("radius", T.DoubleType()),
        T.StructField("least_norm", T.DoubleType()),
        T.StructField("most_norm", T.DoubleType()),
    ]
)
#: Centres come from about so many rows, whatever the size of the table.
SAMPLE_ROWS = 20_000
#: At most so many blocks are asked for by number; more are joined.
LISTED_BLOCKS = 2000
# Rounding of sums of a few thousand products, far above what doubles lose.
_SLACK = 1e-9


def _directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, zero ones as they are, and the lengths."""
    rows = rows.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norms > 0, norms, 1)[:, None], norms


def learn_centres(vectors: DataFrame, centres: int, seed: int = 5, turns: int = 8) -> np.ndarray:
    """Centres of the directions of a bounded sample, by spherical k-means."""
    n = vectors.count()
    share = F.pmod(F.xxhash64(DOC_ID, F.lit(seed)), F.lit(1 << 30))
    sample = vectors.select(DOC_ID, DOC_VECTOR).where(F.col(DOC_VECTOR).isNotNull())
    if n > SAMPLE_ROWS:
        # The filter runs in the scan, so the tasks send twice the sample at most on average.
        sample = sample.where(share < (2 * SAMPLE_ROWS * (1 << 30)) // n)
    element = packed_element(vectors)
    table = sample.select(DOC_VECTOR).limit(2 * SAMPLE_ROWS).toArrow().column(0).combine_chunks()
    if not len(table):
        raise ValueError("there are no vectors")
    dim = check_dim(vectors.limit(1))
    rows, _ = _directions(as_matrix(table, dim, element))
    rows = rows[np.isfinite(rows).all(axis=1)]
    draw = np.random.default_rng(seed)
    found = rows[draw.choice(len(rows), min(centres, len(rows)), replace=False)]
    for _ in range(turns):
        nearest = (rows @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        found = np.where(sums.any(axis=1)[:, None], _directions(sums)[0], found)
    return found


def write_blocks(
    vectors: DataFrame,
    table: str,
    sidecar: str,
    rows_per_block: int = 4096,
    centres: int = 256,
    seed: int = 5,
) -> None:
    """Store a vector table in blocks of similar vectors, and what is known of each block.

    Rows are sorted by their nearest two centres and id over ranges of equal size, so a centre with
    a third of all rows spreads over a third of the files. Rows without a vector are left out.
    """
    present = with_arrays(vectors).where(F.col(DOC_VECTOR).isNotNull())
    found = learn_centres(present, centres, seed)

    @arrow_udf(T.LongType())
    def cell(column: pa.Array) -> pa.Array:
        rows, _ = _directions(as_matrix(column, found.shape[1]))
        scores = np.nan_to_num(rows @ found.T)
        first = scores.argmax(axis=1)
        scores[np.arange(len(rows)), first] = -np.inf
        return pa.array(first * len(found) + scores.argmax(axis=1))

    near = present.withColumn("cell", cell(F.col(DOC_VECTOR)))
    ordered = near.repartitionByRange("cell", DOC_ID).sortWithinPartitions("cell", DOC_ID).drop("cell")
    # A number has the task above bit 33 and the row in it below.
    number, row = F.monotonically_increasing_id(), F.lit((1 << 33) - 1)
    block = F.shiftright(number, 33) * F.lit(1 << 31) + F.expr("nth div " + str(rows_per_block))
    numbered = ordered.withColumn("nth", number.bitwiseAND(row)).withColumn(BLOCK, block).drop("nth")
    write_vectors(numbered, table)
    describe_blocks(vectors.sparkSession.read.parquet(table)).write.parquet(sidecar)


def describe_blocks(stored: DataFrame) -> DataFrame:
    """The sidecar of a table of blocks: a row for each run of a block's rows that a task reads."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> pa.RecordBatch:
            rows, norms = _directions(np.concatenate(parts))
            centre = rows.mean(axis=0)
            radius = np.sqrt(((rows - centre) ** 2).sum(axis=1).max())
            values = [*now, len(rows), centre.tolist(), radius, norms.min(), norms.max()]
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), *[pa.float64()] * 3]
            arrays = [pa.array([v], type=t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(arrays, _SIDECAR.names)

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            if not len(blocks):
                continue
            files, vectors = batch.column(1), batch.column(2)
            rows = as_matrix(vectors, len(vectors[0]))
            starts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for a, b in zip(starts, starts[1:]):
                key = (int(blocks[a]), files[a].as_py())
                if key != now:
                    if now is not None:
                        yield done()
                    now, parts = key, []
                parts.append(rows[a:b])
        if now is not None:
            yield done()

    columns = stored.select(BLOCK, F.col("_metadata.file_name").alias("file"), DOC_VECTOR)
    return columns.mapInArrow(describe, _SIDECAR)


def block_bound(query: Sequence[float], metric: str, clamp: str, eps: float) -> Column:
    """What no score of a block's rows exceeds."""
    check_metric(metric, clamp)
    q = [float(x) for x in query]
    length = sum(x * x for x in q) ** 0.5
    if not length:
        # Every product is 0, and so is every score.
        return F.lit(_SLACK)
    reach = similarity.dot(F.col("centre"), F.lit([x / length for x in q])) + F.col("radius")
    reach = F.least(reach, F.lit(1.0)) + _SLACK
    if metric == "dot":
        return reach * length * F.when(reach >= 0, F.col("most_norm")).otherwise(F.col("least_norm"))
    # The clamp moves the scores of very short vectors toward 0.
    shortest = F.col("least_norm") * (length if clamp == "product" else 1.0)
    return F.when(shortest < eps, F.greatest(reach, F.lit(_SLACK))).otherwise(reach)


def _read(spark: SparkSession, table: str, chosen: DataFrame, columns: T.StructType) -> DataFrame:
    """The rows of some blocks: the files that hold them, and in these the blocks alone."""
    rows = chosen.select(BLOCK, "file").distinct().limit(LISTED_BLOCKS + 1).collect()
    if len(rows) > LISTED_BLOCKS:
        stored = spark.read.schema(columns).parquet(table)
        return stored.join(chosen.select(BLOCK).distinct(), BLOCK, "left_semi")
    if not rows:
        return spark.createDataFrame([], columns)
    files = sorted({r["file"] for r in rows})
    stored = spark.read.schema(columns).parquet(*(f"{table}/{f}" for f in files))
    return stored.where(one_of(BLOCK, (r[BLOCK] for r in rows)))


def search_blocks(
    spark: SparkSession,
    table: str,
    sidecar: str,
    query: Sequence[float],
    k: int = 10,
    *,
    metric: str = "cosine",
    clamp: str = "product",
    eps: float = similarity.EPSILON,
    on_nan: str = "error",
    blocks_read: list[int] | None = None,
) -> DataFrame:
    """The k rows of a table of blocks most similar to ``query``, the same as those of a whole scan.

    A block with a vector that has NaN or infinity is always read. ``blocks_read`` takes the number
    of blocks read first, read next, and of all. A search asks the sidecar twice, in Spark, and the
    driver holds the numbers of at most ``LISTED_BLOCKS`` blocks.
    """
    if k < 1:
        raise ValueError("k must be positive")
    scoring = {"metric": metric, "clamp": clamp, "eps": eps, "on_nan": on_nan}
    columns = spark.read.parquet(table).schema
    bound = block_bound(query, metric, clamp, eps)
    parts = spark.read.schema(_SIDECAR).parquet(sidecar)
    bounds = parts.select(BLOCK, "file", "n_rows", F.when(F.isnan(bound), float("inf")).otherwise(bound).alias("bound"))
    # A block that two tasks described is as far as its farther part.
    bounds = written(
        bounds.groupBy(BLOCK, "file").agg(F.sum("n_rows").alias("n_rows"), F.max("bound").alias("bound")), "blocks"
    )
    total, rows = bounds.agg(F.count("*"), F.sum("n_rows")).head()
    several = max(2, -(-2 * k * total // max(1, rows or 1)))
    first = written(bounds.orderBy(F.desc("bound"), BLOCK).limit(several), "first-blocks")
    best = written(top_k(score_table(_read(spark, table, first, columns), query, **scoring), k), "best")
    kth, n = best.agg(F.min(SIMILARITY), F.count("*")).head()
    rest = bounds.join(first.select(BLOCK, "file"), [BLOCK, "file"], "left_anti")
    rest = rest if n < k else rest.where(F.col("bound") >= kth)
    if blocks_read is not None:
        blocks_read += [first.count(), rest.count(), total]
    more = score_table(_read(spark, table, rest, columns), query, **scoring)
    return top_k(best.unionByName(more), k).drop(BLOCK)
