"""Range statistics and int8 quantization of a vector table."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from vectrail.functions.packing import packed_element, with_arrays
from vectrail.operators.fingerprint import fingerprint
from vectrail.functions.quantization import affine_code
from vectrail.functions.scorers import as_matrix, vector_quantizer
from vectrail.schema import DOC_ID, DOC_VECTOR, QUERY_ID, RANGE_STATS

DIMENSION_RANGES = T.StructType([T.StructField("dim", T.IntegerType()), *RANGE_STATS.fields])


def vector_range(vectors: DataFrame) -> DataFrame:
    """One row ``(min_val, max_val)`` over all elements of all vectors; fails on NaN.

    ``array_max`` puts NaN above every number, so one pass finds both the range and any NaN.
    """
    vectors = with_arrays(vectors)
    high = F.max(F.array_max(DOC_VECTOR)).cast("double")
    return vectors.agg(
        F.min(F.array_min(DOC_VECTOR)).cast("double").alias("min_val"), high.alias("max_val")
    ).select(
        "min_val",
        F.when(F.isnan("max_val"), F.raise_error(F.lit("NaN in a vector")))
        .otherwise(F.col("max_val"))
        .alias("max_val"),
    )


def save_range(stats: DataFrame, path: str) -> None:
    """Write range statistics as JSON."""
    stats.select(*RANGE_STATS.names).coalesce(1).write.mode("overwrite").json(path)


def load_range(spark: SparkSession, path: str) -> DataFrame:
    """Read saved range statistics; fails when there are none."""
    return spark.read.schema(RANGE_STATS).json(path)


def range_stats(vectors: DataFrame, path: str, mode: str = "reuse") -> DataFrame:
    """Saved range statistics; computed and saved first if missing or if ``mode='recompute'``."""
    if mode not in ("reuse", "recompute"):
        raise ValueError(f"mode must be 'reuse' or 'recompute', not {mode!r}")
    spark = vectors.sparkSession
    if mode == "reuse":
        try:
            return load_range(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    save_range(vector_range(vectors), path)
    return load_range(spark, path)


def quantize_table(vectors: DataFrame, stats: DataFrame, engine: str = "arrow") -> DataFrame:
    """Replace the float vectors by int8 codes over the range in ``stats``; other columns stay."""
    low, high = stats.select(*RANGE_STATS.names).head()
    if low is None or high is None:
        raise ValueError("the range is empty: there are no vectors")
    vectors = with_arrays(vectors)
    if engine == "arrow":
        codes = vector_quantizer(low, high)(F.col(DOC_VECTOR))
    elif engine == "expr":
        codes = affine_code(F.col(DOC_VECTOR), low, high)
    else:
        raise ValueError(f"engine must be 'arrow' or 'expr', not {engine!r}")
    return vectors.withColumn(DOC_VECTOR, codes)


def dimension_ranges(vectors: DataFrame) -> DataFrame:
    """Rows ``(dim, min_val, max_val)`` of every place of the vectors, from 0; fails on NaN.

    A task returns a row for each place, and these add up, so no vector is moved.
    """
    element, packed = packed_element(vectors), vectors.schema[DOC_VECTOR].dataType == T.BinaryType()

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            column = batch.column(0)
            if len(column):
                first = column[:1]
                width = (pc.binary_length(first) if packed else pc.list_value_length(first))[0].as_py()
                rows = as_matrix(column, width // np.dtype(element).itemsize if packed else width, element)
                if low is not None and rows.shape[1] != len(low):
                    raise ValueError(f"every vector must have {len(low)} values, found {rows.shape[1]}")
                # A minimum or maximum with NaN is NaN.
                low = rows.min(axis=0) if low is None else np.minimum(low, rows.min(axis=0))
                high = rows.max(axis=0) if high is None else np.maximum(high, rows.max(axis=0))
        if low is not None:
            if np.isnan(low).any():
                raise ValueError("NaN in a vector")
            arrays = [pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low.astype(float)), pa.array(high.astype(float))]
            yield pa.RecordBatch.from_arrays(arrays, DIMENSION_RANGES.names)

    parts = vectors.select(DOC_VECTOR).where(F.col(DOC_VECTOR).isNotNull()).mapInArrow(ends, DIMENSION_RANGES)
    return parts.groupBy("dim").agg(F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"))


def save_dimension_ranges(vectors: DataFrame, path: str) -> None:
    """Write the ranges of a table's places with the fingerprint of the table."""
    mark = fingerprint(vectors).head()
    ranges = dimension_ranges(vectors).withColumn("table", F.lit(f"{mark['n_rows']}-{mark['fingerprint']}"))
    ranges.coalesce(1).write.mode("overwrite").json(path)


def load_dimension_ranges(vectors: DataFrame, path: str) -> DataFrame:
    """The saved ranges of this table; fails if they are of another one, or of this before a change."""
    saved = vectors.sparkSession.read.schema(T.StructType([*DIMENSION_RANGES.fields, T.StructField("table", T.StringType())])).json(path)
    mark = fingerprint(vectors).head()
    marks = [r["table"] for r in saved.select("table").distinct().take(2)]
    if mark["n_rows"] and marks != [f"{mark['n_rows']}-{mark['fingerprint']}"]:
        raise ValueError(f"the ranges at {path} are not those of this table")
    return saved.drop("table")


def quantize_per_dimension(vectors: DataFrame, ranges: DataFrame) -> DataFrame:
    """Replace the float vectors by int8 codes, each place over its own range; other columns stay.

    Places differ in width, so codes over their own ranges keep more of narrow ones than codes over
    one range do. Values beyond a range take its nearest code, a range of no width gives -128.
    """
    rows = sorted(map(tuple, ranges.select(*DIMENSION_RANGES.names).collect()))
    if [r[0] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError("the ranges must be those of places 0, 1, 2 and so on")
    low, high = (np.array([r[i] for r in rows], dtype=np.float32) for i in (1, 2))

    @arrow_udf(T.ArrayType(T.ByteType()))
    def codes(column: pa.Array) -> pa.Array:
        present = column.drop_null()
        values = as_matrix(present, len(low)).astype(np.float32, copy=False)
        with np.errstate(divide="ignore", invalid="ignore"):
            level = (values - low) / (high - low) * np.float32(255) - np.float32(128)
        level = np.where(high > low, np.clip(level, -128, 127), np.float32(-128))
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), len(low), 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        absent = column.is_null() if column.null_count else None
        return pa.ListArray.from_arrays(offsets, pa.array(level.astype(np.int8).reshape(-1)), mask=absent)

    return with_arrays(vectors).withColumn(DOC_VECTOR, codes(F.col(DOC_VECTOR)))


def recall_at_k(exact: DataFrame, other: DataFrame, per_query: bool = False) -> DataFrame:
    """The share of the exact hits that another search found too, as ``(hits, found, recall)``.

    Hits of many queries are compared within each query. ``per_query`` gives a row for each of
    them, with its ``query_id``; otherwise there is one row over all.
    """
    keys = [c for c in (QUERY_ID, DOC_ID) if c in exact.columns]
    also = other.select(*keys).distinct().withColumn("also", F.lit(1))
    marked = exact.select(*keys).join(also, keys, "left")
    return marked.groupBy(*([QUERY_ID] if per_query else [])).agg(
        F.count("*").alias("hits"),
        F.count("also").alias("found"),
        F.try_divide(F.count("also"), F.count("*")).alias("recall"),
    )
