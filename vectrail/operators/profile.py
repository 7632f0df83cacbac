"""Checks and summaries of vector tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.functions.packing import array_of, with_arrays
from vectrail.functions.similarity import l2_norm
from vectrail.schema import DOC_VECTOR


def table_profile(vectors: DataFrame) -> DataFrame:
    """One row: number of rows, of rows without a vector, and the range of dimensions."""
    vectors = with_arrays(vectors)
    dim = F.array_size(DOC_VECTOR)
    return vectors.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(DOC_VECTOR).isNull()).alias("n_missing"),
        F.min(dim).alias("min_dim"),
        F.max(dim).alias("max_dim"),
    )


def check_dim(vectors: DataFrame) -> int:
    """The dimension of the table; fails when it is empty or its vectors differ in length."""
    present = vectors.where(F.col(DOC_VECTOR).isNotNull())
    low, high = table_profile(present).select("min_dim", "max_dim").head()
    if low is None or low != high:
        raise ValueError(f"vectors do not have one dimension: {low} to {high}")
    return low


def pair_counts(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row ``(n_ids, n_vectors, matched)`` comparing both halves of a raw pair."""
    sides = ids.select(F.lit(1).alias("id"), F.lit(0).alias("vector")).unionAll(
        vectors.select(F.lit(0), F.lit(1))
    )
    counted = sides.agg(F.sum("id").alias("n_ids"), F.sum("vector").alias("n_vectors"))
    return counted.withColumn("matched", F.col("n_ids") == F.col("n_vectors"))


def with_norm(vectors: DataFrame, name: str = "norm") -> DataFrame:
    """Add the length of each vector, to be stored with it and reused by every search."""
    return vectors.withColumn(name, l2_norm(array_of(vectors)))
