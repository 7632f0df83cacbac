"""Arrow-batched kernels: one fixed query, or one fixed range, against a column of vectors."""

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, ByteType, DoubleType

from vectrail.functions.similarity import EPSILON, SCORE_DECIMALS

# Batches are worked on in pieces of about this many elements, to stay in cache.
_PIECE = 1 << 17


def as_matrix(vectors: pa.Array, dim: int, element: str = "float32") -> np.ndarray:
    """The rows of a vector column without NULLs as a matrix, sharing the Arrow buffer.

    The column holds lists of numbers, or packed vectors of the given element type.
    """
    if not len(vectors):
        return np.empty((0, dim))
    packed = pa.types.is_binary(vectors.type) or pa.types.is_large_binary(vectors.type)
    kind = np.dtype(element).newbyteorder("<")
    sizes = pc.min_max(pc.binary_length(vectors) if packed else pc.list_value_length(vectors))
    low, high = (sizes[end].as_py() / (kind.itemsize if packed else 1) for end in ("min", "max"))
    if not low == high == dim:
        raise ValueError(f"every vector must have {dim} values, found {low:g} to {high:g}")
    if not packed:
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)
    offsets = np.int64 if pa.types.is_large_binary(vectors.type) else np.int32
    first = int(np.frombuffer(vectors.buffers()[1], offsets)[vectors.offset])
    values = np.frombuffer(vectors.buffers()[2], kind, len(vectors) * dim, first)
    return values.reshape(len(vectors), dim)


class Queries(NamedTuple):
    """Query vectors ready for scoring."""

    # One column per query; of length one for cosine.
    columns: np.ndarray
    # The smallest norm of a row to divide by, per query; None for the dot product.
    least_norms: np.ndarray | None


def prepare_queries(queries: np.ndarray, metric: str, clamp: str, eps: float) -> Queries:
    """Queries in the rows of a matrix, with all that does not depend on the document done."""
    queries = np.asarray(queries, dtype=np.float64)
    if metric == "dot":
        return Queries(np.ascontiguousarray(queries.T), None)
    norms = np.linalg.norm(queries, axis=1)
    if clamp == "doc" and not norms.all():
        raise ValueError("a zero query has no direction; use clamp='product' to score it 0")
    norms[norms == 0] = 1.0
    # A product of norms of at least eps is a document norm of at least eps / query norm.
    least = np.full(len(norms), eps) if clamp == "doc" else eps / norms
    return Queries(np.ascontiguousarray((queries / norms[:, None]).T), least)


def similarities(
    rows: np.ndarray, queries: Queries, row_norms: np.ndarray | None = None
) -> np.ndarray:
    """Unrounded scores of every row against every query."""
    scores = np.empty((len(rows), queries.columns.shape[1]))
    step = max(1, _PIECE // max(1, rows.shape[1]))
    for start in range(0, len(rows), step):
        piece = rows[start : start + step].astype(np.float64)
        out = np.matmul(piece, queries.columns, out=scores[start : start + step])
        if queries.least_norms is None:
            continue
        if row_norms is None:
            norms = np.sqrt(np.einsum("ij,ij->i", piece, piece))
        else:
            norms = row_norms[start : start + step]
        if norms.min() >= queries.least_norms.max():
            out /= norms[:, None]
        else:
            out /= np.maximum(norms[:, None], queries.least_norms)
    return scores


def check_metric(metric: str, clamp: str) -> None:
    if metric not in ("cosine", "dot"):
        raise ValueError(f"metric must be 'cosine' or 'dot', not {metric!r}")
    if clamp not in ("product", "doc"):
        raise ValueError(f"clamp must be 'product' or 'doc', not {clamp!r}")


def query_scorer(
    query: Sequence[float],
    metric: str = "cosine",
    clamp: str = "product",
    eps: float = EPSILON,
    element: str = "float32",
) -> Callable[..., Column]:
    """A column function that scores a vector column against ``query``.

    Call it with the vector column, and with a column of stored norms if there is one. A NULL
    vector scores NULL. ``element`` is the element type of packed vectors. The function is
    non-deterministic to Spark, which keeps it from moving a later filter by score below the
    projection and scoring everything twice.
    """
    check_metric(metric, clamp)
    q = np.asarray(query, dtype=np.float64)
    if q.ndim != 1 or not len(q):
        raise ValueError("the query must be one non-empty vector")
    prepared = prepare_queries(q[None, :], metric, clamp, eps)

    def score(vectors: pa.Array, norms: pa.Array | None = None) -> pa.Array:
        present = vectors.drop_null()
        known = None if norms is None else norms.filter(vectors.is_valid()).to_numpy(zero_copy_only=False)
        scores = similarities(as_matrix(present, len(q), element), prepared, known)[:, 0]
        values = np.round(scores, SCORE_DECIMALS)
        if not vectors.null_count:
            return pa.array(values)
        scattered = np.zeros(len(vectors))
        absent = vectors.is_null().to_numpy(zero_copy_only=False)
        scattered[~absent] = values
        return pa.array(scattered, mask=absent)

    @arrow_udf(DoubleType())
    def score_vectors(vectors: pa.Array) -> pa.Array:
        return score(vectors)

    @arrow_udf(DoubleType())
    def score_with_norms(vectors: pa.Array, norms: pa.Array) -> pa.Array:
        return score(vectors, norms)

    score_vectors = score_vectors.asNondeterministic()
    score_with_norms = score_with_norms.asNondeterministic()
    return lambda v, norm=None: score_vectors(v) if norm is None else score_with_norms(v, norm)


def code_values(values: np.ndarray, low: np.float32, width: np.float32) -> np.ndarray:
    """The int8 codes of numbers in the range of this width above ``low``."""
    values = values.astype(np.float32, copy=False)
    whole = np.full(len(values), -128, dtype=np.int8)
    for start in range(0, len(values) if width > 0 else 0, _PIECE):
        piece = values[start : start + _PIECE] - low
        piece /= width
        piece *= np.float32(255)
        piece -= np.float32(128)
        np.clip(piece, -128, 127, out=piece)
        # Conversion to integers truncates toward zero.
        whole[start : start + _PIECE] = piece
    return whole


def vector_quantizer(min_val: float, max_val: float) -> Callable[[Column], Column]:
    """A column function from float vectors to int8 codes, by the same rule as
    :func:`vectrail.functions.quantization.affine_code`."""
    low, width = np.float32(min_val), np.float32(max_val) - np.float32(min_val)

    @arrow_udf(ArrayType(ByteType()))
    def codes(vectors: pa.Array) -> pa.Array:
        present = vectors.drop_null()
        whole = code_values(present.flatten().to_numpy(zero_copy_only=False), low, width)
        lengths = pc.list_value_length(vectors)
        ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False), dtype=np.int32)
        offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
        absent = vectors.is_null() if vectors.null_count else None
        return pa.ListArray.from_arrays(offsets, pa.array(whole), mask=absent)

    return codes
