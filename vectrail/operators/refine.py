"""Exact search that reads int8 codes of all rows and float vectors of few.

The distance of each vector from what its codes stand for is stored beside them, so by
Cauchy-Schwarz a search over codes knows an interval that holds each true score. Only rows whose
interval reaches the k-th best lower end can be among the k best.
"""

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions.packing import ELEMENT_KEY, packed_element
from vectrail.functions.scorers import as_matrix, check_metric, code_values
from vectrail.functions.similarity import EPSILON
from vectrail.operators.lookup import rows_by_id
from vectrail.operators.search import search
from vectrail.schema import DOC_ID, DOC_VECTOR, RANGE_STATS
from vectrail.scratch import written

_CODED = T.StructType(
    [
        T.StructField(DOC_ID, T.LongType()),
        T.StructField(DOC_VECTOR, T.BinaryType(), metadata={ELEMENT_KEY: "int8"}),
        T.StructField("norm", T.DoubleType()),
        T.StructField("error", T.DoubleType()),
    ]
)
_BOUNDS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lower", "upper")])
# Rounding of sums of a few thousand products, far above what doubles lose.
_SLACK = 1e-9
# Rows turned into doubles at a time.
_STEP = 4096


def _levels(codes: np.ndarray) -> np.ndarray:
    """The middle of the numbers that a code stands for, in steps of the code."""
    # Codes are truncated toward zero, so zero is twice as wide as the others.
    return codes + 0.5 * np.sign(codes)


def _range(stats: DataFrame) -> tuple[float, float]:
    low, high = stats.select(*RANGE_STATS.names).head()
    if low is None or high is None:
        raise ValueError("the range is empty: there are no vectors")
    return float(np.float32(low)), float(np.float32(high) - np.float32(low))


def refinable_codes(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """``(doc_id, doc_vector)`` of floats to packed int8 codes over the range in ``stats``, with the
    length of each vector and its distance from what its codes stand for.

    Any range is right: a vector beyond it has a larger distance. Rows without a vector are left out.
    """
    low, width = _range(stats)
    element = packed_element(vectors)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            if not len(batch):
                continue
            packed = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
            one = column[:1]
            dim = (pc.binary_length(one)[0].as_py() // np.dtype(element).itemsize) if packed else pc.list_value_length(one)[0].as_py()
            rows = as_matrix(column, dim, element)
            values = code_values(rows.reshape(-1), np.float32(low), np.float32(width)).reshape(len(rows), dim)
            norms, errors = np.empty(len(rows)), np.empty(len(rows))
            for at in range(0, len(rows), _STEP):
                exact = rows[at : at + _STEP].astype(np.float64)
                near = low + (_levels(values[at : at + _STEP]) + 128) * (width / 255)
                norms[at : at + _STEP] = np.sqrt((exact * exact).sum(axis=1))
                errors[at : at + _STEP] = np.sqrt(((exact - near) ** 2).sum(axis=1))
            offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(dim))
            codes = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(values.tobytes())])
            arrays = [batch.column(0), codes, pa.array(norms), pa.array(errors)]
            yield pa.RecordBatch.from_arrays(arrays, _CODED.names)

    present = vectors.select(F.col(DOC_ID).cast("bigint"), DOC_VECTOR).where(F.col(DOC_VECTOR).isNotNull())
    coded = present.mapInArrow(code, _CODED)
    return coded.withMetadata(DOC_VECTOR, {ELEMENT_KEY: "int8"})


def score_bounds(
    codes: DataFrame,
    query: Sequence[float],
    stats: DataFrame,
    k: int,
    *,
    metric: str = "cosine",
    clamp: str = "product",
    eps: float = EPSILON,
) -> DataFrame:
    """Rows ``(doc_id, lower, upper)``: ends of the true score of every row that may be among the k
    best of its task. The score of a vector with NaN or infinity may be anything."""
    check_metric(metric, clamp)
    q = np.asarray(query, dtype=np.float64)
    length = float(np.linalg.norm(q))
    if metric == "cosine" and clamp == "doc" and not length:
        raise ValueError("a zero query has no direction; use clamp='product' to score it 0")
    low, width = _range(stats)

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lower, upper = [], np.empty(0), np.empty(0)

        def prune() -> None:
            nonlocal ids, lower, upper
            joined = pa.concat_arrays(ids)
            if len(lower) > k:
                reaches = upper >= np.partition(lower, len(lower) - k)[len(lower) - k]
                joined, lower, upper = joined.filter(pa.array(reaches)), lower[reaches], upper[reaches]
            ids = [joined]

        for batch in batches:
            coded = as_matrix(batch.column(1), len(q), "int8")
            norms, errors = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for at in range(0, len(coded), _STEP):
                near = _levels(coded[at : at + _STEP])
                part = slice(at, at + len(near))
                score = (near @ q) * (width / 255) + (low + 128 * width / 255) * q.sum()
                error = errors[part] * length
                # Sums cancel, so their rounding goes with the size of the terms.
                slack = _SLACK * (1 + length * (norms[part] + errors[part]))
                if metric == "cosine":
                    least = norms[part] * length if clamp == "product" else norms[part]
                    by = np.maximum(least, eps) * (1.0 if clamp == "product" else length)
                    score, error, slack = score / by, error / by, slack / by + _SLACK
                wild = ~np.isfinite(score + error)
                low_end, high_end = score - error - slack, score + error + slack
                low_end[wild], high_end[wild] = -np.inf, np.inf
                lower, upper = np.concatenate([lower, low_end]), np.concatenate([upper, high_end])
            ids.append(batch.column(0))
            prune()
        if ids:
            yield pa.RecordBatch.from_arrays([ids[0], pa.array(lower), pa.array(upper)], [DOC_ID, "lower", "upper"])

    schema = T.StructType([_CODED[DOC_ID], *_BOUNDS.fields])
    return codes.select(*_CODED.names).mapInArrow(bounds, schema)


def search_refined(
    codes: DataFrame,
    vectors: DataFrame,
    query: Sequence[float],
    stats: DataFrame,
    k: int = 10,
    *,
    refined: list[int] | None = None,
    **scoring,
) -> DataFrame:
    """The same rows as :func:`vectrail.operators.search.search` over ``vectors``, of which only those
    are read whose score may be among the k best.

    ``codes`` come from :func:`refinable_codes` over the same vectors and range. ``refined`` takes the
    number of rows scored exactly. Ids may repeat or be NULL; all rows of an id are then scored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    bounded = {name: scoring[name] for name in ("metric", "clamp", "eps") if name in scoring}
    found = written(score_bounds(codes, query, stats, k, **bounded), "bounds")
    kth, n = found.orderBy(F.desc("lower")).limit(k).agg(F.min("lower"), F.count("*")).head()
    reach = found if n < k else found.where(F.col("upper") >= kth)
    if refined is not None:
        refined.append(reach.count())
    return search(rows_by_id(vectors, reach, nulls=True), query, k, **scoring)
