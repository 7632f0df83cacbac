"""Vectors as binary values: the bytes of their float32 or int8 elements, one after another.

Spark moves a binary value in one piece but an array element by element, so scanning packed vectors
takes about half the time. The searches take either form.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, ByteType, FloatType

from vectrail.schema import DOC_VECTOR

# The element type of a packed column stands in its metadata, which parquet files keep.
ELEMENT_KEY = "element"


def _packed(vectors: pa.Array, element: str) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    width = np.dtype(element).itemsize
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths * width, dtype=np.int32)])
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(element, copy=False)
    valid = vectors.is_valid().cast(pa.int8()).to_numpy(zero_copy_only=False)
    bitmap = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    buffers = [bitmap, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(vectors), buffers)


def _unpacked(packed: pa.Array, element: str) -> pa.Array:
    width = np.dtype(element).itemsize
    content = b"".join(packed.drop_null().to_pylist())
    lengths = pc.fill_null(pc.binary_length(packed), 0).to_numpy(zero_copy_only=False) // width
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
    absent = packed.is_null() if packed.null_count else None
    values = pa.array(np.frombuffer(content, element))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=absent)


def packed_element(vectors: DataFrame) -> str:
    """The element type of the packed vectors of a table, float32 unless it says otherwise."""
    return vectors.schema[DOC_VECTOR].metadata.get(ELEMENT_KEY, "float32")


@arrow_udf(BinaryType())
def pack_floats(vectors: pa.Array) -> pa.Array:
    """An array of floats as packed float32."""
    return _packed(vectors, "<f4")


@arrow_udf(BinaryType())
def pack_codes(vectors: pa.Array) -> pa.Array:
    """An array of int8 codes as packed int8."""
    return _packed(vectors, "i1")


@arrow_udf(ArrayType(FloatType()))
def unpack_floats(packed: pa.Array) -> pa.Array:
    """The array of floats of packed float32."""
    return _unpacked(packed, "<f4")


@arrow_udf(ArrayType(ByteType()))
def unpack_codes(packed: pa.Array) -> pa.Array:
    """The array of codes of packed int8."""
    return _unpacked(packed, "i1")


def array_of(vectors: DataFrame) -> Column:
    """The vectors of a table as arrays, whether they are stored as such or packed."""
    if vectors.schema[DOC_VECTOR].dataType != BinaryType():
        return F.col(DOC_VECTOR)
    return (unpack_codes if packed_element(vectors) == "int8" else unpack_floats)(F.col(DOC_VECTOR))


def with_arrays(vectors: DataFrame) -> DataFrame:
    """The same table with its vectors as arrays."""
    if vectors.schema[DOC_VECTOR].dataType != BinaryType():
        return vectors
    return vectors.withColumn(DOC_VECTOR, array_of(vectors)).withMetadata(DOC_VECTOR, {})
