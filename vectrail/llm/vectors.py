"""Vectors as packed binary values of double precision's source type, without those that take no part."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.folds import bounded_sample
from vectrail.scratch import written


def usable_dimension(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, the larger one of equals; 0 without vectors."""
    sizes = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d"))
    best = sizes.agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def pack_usable(rows: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """``(key, packed)`` of the vectors that take part: of the given dimension, not zero, without
    null or non-finite components, with a non-null key. ``packed`` holds float64 or float32 values,
    as the table does; read it with :func:`matrix`."""
    kind = rows.schema[vector].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values = np.array(batch["vector"].tolist(), dtype=dtype).reshape(len(batch), -1)
                good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
                packed = [v.tobytes() for v in values[good]]
                yield pd.DataFrame({"key": batch["key"][good], "packed": packed})

    right = F.col(key).isNotNull() & (F.size(vector) == dimension) & (F.size(vector) > 0)
    # A null component makes a batch an array of objects; such rows go before.
    right = right & ~F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(True))
    slim = rows.where(right).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    return slim.mapInPandas(pack, "key long, packed binary").withColumnRenamed("key", key)


def one_vector_per_key(packed: DataFrame) -> DataFrame:
    """``(key, packed)``, stored, with a row for each key: of a key with several vectors the least by its
    bytes stands for all. Only keys are shuffled, and the vectors of those that repeat."""
    stored = written(packed, "vectors")
    several = written(stored.groupBy("key").count().where("count > 1").select("key"), "repeated-keys")
    if several.isEmpty():
        return stored
    least = stored.join(several, "key", "left_semi").groupBy("key").agg(F.min("packed").alias("packed"))
    return written(stored.join(several, "key", "left_anti").unionByName(least), "vectors")


def matrix(packed, dimension: int) -> np.ndarray:
    """Packed vectors as rows of a float64 matrix."""
    packed = list(packed)
    if not packed:
        return np.empty((0, dimension))
    dtype = np.float32 if len(packed[0]) == 4 * dimension else np.float64
    return np.frombuffer(b"".join(packed), dtype).reshape(-1, dimension).astype(np.float64)


def sample_matrix(rows: DataFrame, key: str, n: int, dimension: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of at most ``n`` rows, the same ones for the same table."""
    found = bounded_sample(rows.select(key, "packed"), key, n, seed).toPandas()
    return found[key].to_numpy(np.int64), matrix(found["packed"].map(bytes), dimension)
