"""Column names and table schemas shared by every stage."""

from pyspark.sql import types as T

DOC_ID = "doc_id"
DOC_VECTOR = "doc_vector"
QUERY_ID = "query_id"
QUERY_VECTOR = "query_vector"
SIMILARITY = "similarity"
RANK = "rank"

# One author as it stands in the XML, before the display list is made.
AUTHOR = T.StructType(
    [T.StructField("fore_name", T.StringType()), T.StructField("last_name", T.StringType())]
)

# Text fields of one article record, exactly as found in the XML.
RAW_ARTICLE = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("medline_date", T.StringType()),
        T.StructField("authors", T.ArrayType(AUTHOR)),
    ]
)

# The article table. ``doc_id`` is ``pmid`` as a number (NULL when it is none), so that joins with
# vectors need no cast; ``publication_year_raw`` keeps dates that are not numbers.
ARTICLE_COLUMNS = [
    "pmid",
    DOC_ID,
    "title",
    "authors",
    "abstract",
    "publication_year",
    "publication_year_raw",
]

ARTICLES = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField(DOC_ID, T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("publication_year", T.IntegerType()),
        T.StructField("publication_year_raw", T.StringType()),
    ]
)

# Position of a record in its source; the order by which the first copy of a key wins.
SOURCE_ORDER = ["source_file", "source_block", "source_row"]

VECTORS = T.StructType(
    [
        T.StructField(DOC_ID, T.LongType()),
        T.StructField(DOC_VECTOR, T.ArrayType(T.FloatType())),
    ]
)

RANGE_STATS = T.StructType(
    [T.StructField("min_val", T.DoubleType()), T.StructField("max_val", T.DoubleType())]
)

# What a search returns for each hit besides the query and its rank.
DOCUMENT_COLUMNS = ["pmid", "title", "authors", "abstract", "publication_year"]
