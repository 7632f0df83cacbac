"""Which rows a classifier may learn from, and bounded samples of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the crc32 of the id's text leaves ``fold`` modulo ``folds``; a null id counts as ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


#: Bits of the hash by which rows are counted at once; their cells come to the driver.
_CELL_BITS = 12


def _hash_bound(hashes: DataFrame, n: int) -> int | None:
    """A hash that at least the ``n`` lowest rows do not exceed and few others; None if all are few.

    Rows are counted by the leading bits of their hash, then within the cell that holds the n-th row.
    """
    low, bits, before = -(1 << 63), 64, 0
    while True:
        step = bits - _CELL_BITS if bits > _CELL_BITS else 0
        inside = hashes.where(F.col("hash").between(low, low + (1 << bits) - 1)) if bits < 64 else hashes
        cells = inside.groupBy(F.shiftright("hash", step).alias("cell")).agg(F.count("*").alias("n"))
        found = sorted((r["cell"], r["n"]) for r in cells.collect())  # 1 << _CELL_BITS rows at most
        if bits == 64 and sum(m for _, m in found) <= 4 * n:
            return None
        for cell, m in found:
            if before + m >= n:
                break
            before += m
        if before + m <= 4 * n or not step:
            return ((cell + 1) << step) - 1
        low, bits = cell << step, step


def bounded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows whose keys hash lowest, or all: the same rows whatever the partitioning.

    Keys are counted first, so that a filter in the scan leaves about ``n`` rows to be ordered in one
    task, at most ``4 n`` unless rows share their key. ``rows`` is read two or three times.
    """
    mixed = F.xxhash64(F.col(key), F.lit(seed))
    bound = _hash_bound(rows.select(mixed.alias("hash")), n)
    few = rows if bound is None else rows.where(mixed <= bound)
    return few.orderBy(mixed, key).limit(n)
