"""A fingerprint of vector tables that does not depend on the order of rows."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.functions.packing import packed_element
from vectrail.functions.scorers import as_matrix
from vectrail.schema import DOC_ID, DOC_VECTOR

# Independent sums of 64 bits each, kept as two halves that Spark can add without overflow.
_LANES = 2
_PARTS = [f"p{i}" for i in range(2 * _LANES)]
_STEP = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_hashes(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash in each lane of rows of an id and 32-bit words, by random odd weights for each place."""
    out = np.empty((len(ids), _LANES), dtype=np.uint64)
    for lane in range(_LANES):
        draw = np.random.default_rng([2025, lane])
        weights = draw.integers(0, 1 << 64, words.shape[1] + 1, dtype=np.uint64) | np.uint64(1)
        total = _mixed(ids.view(np.uint64) * weights[0] + np.uint64(words.shape[1]))
        for at in range(0, len(ids), max(1, _STEP // max(1, words.shape[1]))):
            piece = words[at : at + max(1, _STEP // max(1, words.shape[1]))].astype(np.uint64)
            total[at : at + len(piece)] += (_mixed(piece + weights[1:]) * weights[1:]).sum(axis=1, dtype=np.uint64)
        out[:, lane] = _mixed(total)
    return out


def fingerprint(vectors: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_missing, fingerprint)`` of the ids and the bits of the vectors of a table.

    Equal tables have equal fingerprints however their rows are ordered, split or stored, as arrays
    or packed; one changed bit changes 128 bits of it. Sums of row hashes, unlike their exclusive or,
    also tell repeated rows. A task returns one row, and the rows add up, so fingerprints of parts of
    a table can be added too. Rows without a vector count in ``n_missing``, a NULL id as an id of its own.
    """
    element = packed_element(vectors)
    packed = vectors.schema[DOC_VECTOR].dataType.typeName() == "binary"

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, missing = np.zeros(_LANES, dtype=np.uint64), 0, 0
        for batch in batches:
            known = batch.column(1).is_valid()
            missing += len(batch) - known.true_count
            column, ids = batch.column(1).filter(known), batch.column(0).filter(known)
            rows += len(column)
            if not len(column):
                continue
            widths = pc.binary_length(column) if packed else pc.list_value_length(column)
            numbers = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            for width in widths.unique().to_pylist():
                at = pc.equal(widths, width).to_numpy(zero_copy_only=False)
                dim = width // np.dtype(element).itemsize if packed else width
                rows_of = np.ascontiguousarray(as_matrix(column.filter(pa.array(at)), dim, element))
                bits = rows_of.view(np.uint8) if rows_of.itemsize == 1 else rows_of.astype("<f4", copy=False).view("<u4")
                hashes = row_hashes(np.ascontiguousarray(numbers[at]), bits)
                hashes[absent[at]] = _mixed(hashes[absent[at]] + np.uint64(1))
                total += hashes.sum(axis=0, dtype=np.uint64)
        halves = [int(h) for t in total for h in (t >> np.uint64(32), t & np.uint64(0xFFFFFFFF))]
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(["n_rows", "n_missing", *_PARTS], [rows, missing, *halves])})

    schema = ", ".join(f"{n} bigint" for n in ["n_rows", "n_missing", *_PARTS])
    parts = vectors.select(F.col(DOC_ID).cast("bigint"), DOC_VECTOR).mapInArrow(sums, schema)
    added = parts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ["n_rows", "n_missing", *_PARTS]))
    lanes = []
    for high, low in zip(_PARTS[::2], _PARTS[1::2]):
        # Both halves modulo 2^32, with what the lower one carries.
        carry = F.shiftright(F.col(low), 32)
        lanes += [F.lpad(F.hex((F.col(high) + carry).bitwiseAND(0xFFFFFFFF)), 8, "0"), F.lpad(F.hex(F.col(low).bitwiseAND(0xFFFFFFFF)), 8, "0")]
    return added.select("n_rows", "n_missing", F.lower(F.concat(*lanes)).alias("fingerprint"))


def same_content(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_other, matched)``: whether two vector tables hold the same rows."""
    a = one.transform(fingerprint).select(F.col("n_rows"), F.struct("*").alias("a"))
    b = other.transform(fingerprint).select(F.col("n_rows").alias("n_other"), F.struct("*").alias("b"))
    # Each side is one row.
    return a.join(b, F.lit(True)).select("n_rows", "n_other", (F.col("a") == F.col("b")).alias("matched"))
