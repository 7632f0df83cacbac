"""Similarity as plain column expressions.

Both arguments may be columns. All sums run in double, whatever the element type, so float32 and
int8 vectors go through the same code. For one fixed query over a large table use
:mod:`vectrail.functions.scorers`, which gives the same scores several times faster.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the smallest norm (or product of norms) that a dot product is divided by.
EPSILON = 1e-5
# Scores are rounded to this many decimals before ranking, so equal vectors tie whatever the
# order of summation.
SCORE_DECIMALS = 12


def dot(v: Column, q: Column) -> Column:
    """Sum of products; NULL when the lengths differ or an element is NULL."""
    products = F.zip_with(v, q, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_norm(v: Column) -> Column:
    """Euclidean length."""
    squares = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s))


def l2_normalize(v: Column) -> Column:
    """The vector scaled to length one; NULL for a zero vector."""
    norms = F.array_repeat(F.nullif(l2_norm(v), F.lit(0.0)), F.size(v))
    return F.when(
        F.element_at(norms, 1).isNotNull(),
        F.zip_with(v, norms, lambda x, n: x.cast("double") / n),
    )


def cosine(v: Column, q: Column, clamp: str = "product", eps: float = EPSILON) -> Column:
    """Cosine similarity of document ``v`` and query ``q``.

    ``clamp='product'`` bounds the product of both norms from below, so a zero query scores 0.
    ``clamp='doc'`` bounds the document norm only; a zero query has no direction and scores NULL.
    """
    if clamp == "product":
        return dot(v, q) / F.greatest(l2_norm(v) * l2_norm(q), F.lit(eps))
    if clamp == "doc":
        return F.try_divide(dot(v, q), l2_norm(q)) / F.greatest(l2_norm(v), F.lit(eps))
    raise ValueError(f"clamp must be 'product' or 'doc', not {clamp!r}")


def nan_guard(score: Column, policy: str = "error") -> Column:
    """Make undefined scores fail the job (``error``) or turn them into NULL (``null``).

    Spark sorts NaN above every number, so an unguarded NaN would lead every ranking.
    """
    undefined = score.isNull() | F.isnan(score)
    if policy == "error":
        return F.when(undefined, F.raise_error(F.lit("undefined similarity"))).otherwise(score)
    if policy == "null":
        return F.when(~undefined, score)
    raise ValueError(f"policy must be 'error' or 'null', not {policy!r}")
