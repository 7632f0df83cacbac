"""Exact top-k search for one query vector."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions import similarity
from vectrail.functions.packing import packed_element, with_arrays
from vectrail.functions.scorers import check_metric, query_scorer
from vectrail.operators.selection import smallest_by_key
from vectrail.schema import DOC_ID, DOC_VECTOR, RANK, SIMILARITY


def score_table(
    vectors: DataFrame,
    query: Sequence[float],
    *,
    metric: str = "cosine",
    clamp: str = "product",
    eps: float = similarity.EPSILON,
    on_nan: str = "error",
    engine: str = "arrow",
    norm_column: str | None = None,
    score_name: str = SIMILARITY,
) -> DataFrame:
    """Append the similarity of every row to ``query`` and drop the vector; other columns stay.

    Rows without a vector are left out. ``on_nan='error'`` fails the job on an undefined score,
    ``'drop'`` leaves such rows out. ``engine='arrow'`` scores in Arrow batches, ``'expr'`` inside
    the plan; the scores are the same.
    """
    check_metric(metric, clamp)
    if on_nan not in ("error", "drop"):
        raise ValueError(f"on_nan must be 'error' or 'drop', not {on_nan!r}")
    present = vectors.where(F.col(DOC_VECTOR).isNotNull())
    if engine == "arrow":
        scorer = query_scorer(query, metric, clamp, eps, packed_element(vectors))
        score = scorer(F.col(DOC_VECTOR), *([F.col(norm_column)] if norm_column else []))
    elif engine == "expr":
        present = with_arrays(present)
        score = _score_expression(query, metric, clamp, eps, norm_column)
    else:
        raise ValueError(f"engine must be 'arrow' or 'expr', not {engine!r}")
    others = [c for c in vectors.columns if c not in (DOC_VECTOR, norm_column)]
    scored = present.select(*others, score.alias(score_name))
    guarded = similarity.nan_guard(F.col(score_name), "error" if on_nan == "error" else "null")
    scored = scored.withColumn(score_name, guarded)
    return scored if on_nan == "error" else scored.where(F.col(score_name).isNotNull())


def _score_expression(
    query: Sequence[float], metric: str, clamp: str, eps: float, norm_column: str | None
) -> Column:
    query = [float(x) for x in query]
    norm = sum(x * x for x in query) ** 0.5
    if metric == "cosine" and clamp == "doc" and norm == 0:
        raise ValueError("a zero query has no direction; use clamp='product' to score it 0")
    v = F.col(DOC_VECTOR)
    score = similarity.dot(v, F.lit(query))
    if metric == "cosine":
        length = F.col(norm_column) if norm_column else similarity.l2_norm(v)
        if clamp == "product":
            score = score / F.greatest(length * F.lit(norm), F.lit(eps))
        else:
            score = score / F.lit(norm) / F.greatest(length, F.lit(eps))
    return F.round(score, similarity.SCORE_DECIMALS)


def top_k(scored: DataFrame, k: int, score_name: str = SIMILARITY) -> DataFrame:
    """The ``k`` rows of highest score, ties by ascending id: k per partition, then k overall."""
    if k < 0:
        raise ValueError("k must not be negative")
    return scored.orderBy(F.col(score_name).desc(), F.col(DOC_ID).asc()).limit(k)


def search(
    vectors: DataFrame,
    query: Sequence[float],
    k: int = 10,
    *,
    num_records: int | None = None,
    **scoring,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` most similar to ``query``, best first.

    Returns ``min(k, rows)`` rows. ``num_records`` restricts the search to that many rows of lowest
    id. Further arguments go to :func:`score_table`.
    """
    if num_records is not None:
        vectors = smallest_by_key(vectors, DOC_ID, num_records)
    return top_k(score_table(vectors, query, **scoring), k)


def with_rank(hits: DataFrame, by: Sequence[str] = (), score_name: str = SIMILARITY) -> DataFrame:
    """Number the hits of each group 1, 2, ... in result order.

    Meant for the few rows that a search returns: without ``by`` they are numbered in one task.
    """
    order = f"{score_name} DESC, {DOC_ID} ASC"
    groups = "PARTITION BY " + ", ".join(by) if by else ""
    return hits.withColumn(RANK, F.expr(f"row_number() OVER ({groups} ORDER BY {order})"))
