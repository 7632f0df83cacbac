"""Affine int8 codes as a plain column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def affine_code(v: Column, min_val: float, max_val: float) -> Column:
    """Map ``[min_val, max_val]`` onto codes -128 .. 127 in float32, truncating toward zero.

    Values beyond the range take the nearest code. A range of zero width gives -128 throughout.
    """
    low, high = F.lit(min_val).cast("float"), F.lit(max_val).cast("float")
    if not max_val > min_val:
        return F.transform(v, lambda x: F.lit(-128).cast("tinyint"))

    def code(x: Column) -> Column:
        scaled = (x - low) / (high - low)
        level = scaled.cast("float") * F.lit(255).cast("float") - F.lit(128).cast("float")
        bounded = F.least(F.greatest(level, F.lit(-128).cast("float")), F.lit(127).cast("float"))
        return bounded.cast("tinyint")

    return F.transform(v, code)
