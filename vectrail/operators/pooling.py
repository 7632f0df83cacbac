"""Mean pooling of token vectors into one vector per document."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.schema import DOC_ID, DOC_VECTOR


def masked_mean_pool(
    tokens: DataFrame,
    vector: str = "vec",
    mask: str | None = "mask",
    key: str = DOC_ID,
    dtype: str = "float32",
) -> DataFrame:
    """Average the token vectors of each document over the tokens whose mask is 1.

    ``mask=None`` averages over all tokens. A document without any such token gets NULL. Vectors
    are summed on the map side first: one partial sum per document and task is shuffled, so the
    tokens of a document are never brought together.
    """
    counts = F.lit(True) if mask is None else F.coalesce(F.col(mask) == 1, F.lit(False))
    # Masked tokens add zeros, so one pass finds all documents, those without any token too.
    zeros = F.transform(vector, lambda x: F.lit(0.0))
    content = array_to_vector(F.when(counts, F.col(vector).cast("array<double>")).otherwise(zeros))
    pooled = tokens.groupBy(key).agg(
        Summarizer.sum(content).alias("total"), F.count_if(counts).alias("n_counted")
    )
    number = F.nullif(F.col("n_counted"), F.lit(0))
    total = vector_to_array("total")
    element = "float" if dtype == "float32" else "double"
    mean = F.transform(total, lambda x: (x / number).cast(element))
    return pooled.select(key, F.when(number.isNotNull(), mean).alias(DOC_VECTOR))
