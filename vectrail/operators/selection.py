"""The n rows of smallest key, without sorting or moving the table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Key intervals counted in one pass; also the most rows a pass brings to the driver.
_INTERVALS = 4096


def nth_key(df: DataFrame, key: str, n: int) -> tuple[int, int, int] | None:
    """The ``n``-th smallest integer key, and how many rows are below it and at it.

    None if there are fewer rows.

    Each pass reads the key column only, counts it in a fixed number of intervals and goes on in
    the interval that holds the n-th row.
    """
    keys = df.select(F.col(key).cast("bigint").alias("key")).where(F.col("key").isNotNull())
    low, high, rows = keys.agg(F.min("key"), F.max("key"), F.count("key")).head()
    if n > rows:
        return None
    below, count = 0, rows
    while low < high:
        width = -(-(high - low + 1) // _INTERVALS)
        counted = (
            keys.where(F.col("key").between(low, high))
            .groupBy(F.expr(f"key div {width}L - if(key % {width}L < 0, 1, 0)").alias("interval"))
            .count()
            .collect()
        )
        for interval, count in sorted(map(tuple, counted)):
            if below + count >= n:
                break
            below += count
        low, high = max(low, interval * width), min(high, (interval + 1) * width - 1)
    return low, below, count


def smallest_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest ``key``; among rows equal to the last key any may be kept."""
    if n <= 0:
        return df.limit(0)
    found = nth_key(df, key, n)
    if found is None:
        return df
    last, below, at_last = found
    if below + at_last == n:
        return df.where(F.col(key) <= last)
    ties = df.where(F.col(key) == last).limit(n - below)
    return df.where(F.col(key) < last).unionByName(ties)
