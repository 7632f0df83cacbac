"""Reading and writing the parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions.packing import ELEMENT_KEY, pack_codes, pack_floats
from vectrail.schema import ARTICLE_COLUMNS, DOC_ID, DOC_VECTOR

# Rows of one vector file.
RECORDS_PER_FILE = 1_000_000
# Rows of one page of an article file, and how its texts are compressed: to two thirds of snappy's size.
ROWS_PER_PAGE = 1000
ARTICLE_CODEC = "zstd"


def read_vectors(
    spark: SparkSession, path: str, id_column: str = DOC_ID, vector_column: str = DOC_VECTOR
) -> DataFrame:
    """A vector table as ``(doc_id, doc_vector, ...)``, whatever its id and vector are called."""
    renamed = {id_column: DOC_ID, vector_column: DOC_VECTOR}
    return spark.read.parquet(path).withColumnsRenamed(renamed)


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """The vector table with its arrays, of floats or of int8 codes, as packed binary values."""
    codes = vectors.schema[DOC_VECTOR].dataType.elementType == T.ByteType()
    packed = (pack_codes if codes else pack_floats)(F.col(DOC_VECTOR))
    element = {ELEMENT_KEY: "int8" if codes else "float32"}
    return vectors.withColumn(DOC_VECTOR, packed).withMetadata(DOC_VECTOR, element)


def write_vectors(
    vectors: DataFrame,
    path: str,
    mode: str = "error",
    records_per_file: int = RECORDS_PER_FILE,
    packed: bool = False,
) -> None:
    """Write a vector table where its rows are, without a shuffle.

    Vector elements hardly repeat, so they are stored without a dictionary. ``packed=True`` stores
    binary values instead of arrays, which are scanned about twice as fast.
    """
    (
        (pack_vectors(vectors) if packed else vectors)
        .write.mode(mode)
        .option("maxRecordsPerFile", records_per_file)
        .option(f"parquet.enable.dictionary#{DOC_VECTOR}", "false")
        .option(f"parquet.enable.dictionary#{DOC_VECTOR}.list.element", "false")
        .parquet(path)
    )


def read_articles_table(spark: SparkSession, path: str) -> DataFrame:
    """The article table."""
    return spark.read.parquet(path)


def write_articles(articles: DataFrame, path: str, mode: str = "error") -> None:
    """Write the article table where its rows are, in id order within each file.

    After first-wins an id lies in one file, so the texts are not shuffled again. Each row group
    has a bloom filter of its ids, by which a lookup of single ids skips the others, and pages of few
    rows, of which it reads those alone that may hold an id.
    """
    (
        articles.select(*ARTICLE_COLUMNS)
        .sortWithinPartitions(DOC_ID, "pmid")
        .write.mode(mode)
        .option("compression", ARTICLE_CODEC)
        .option(f"parquet.bloom.filter.enabled#{DOC_ID}", "true")
        .option("parquet.page.row.count.limit", ROWS_PER_PAGE)
        .parquet(path)
    )


def write_bucketed(table: DataFrame, name: str, path: str, buckets: int, key: str = DOC_ID) -> DataFrame:
    """Store a table in buckets of its ids under a name of the session's catalog, and read it.

    Tables of equal ``buckets`` join by id without moving a row, and a filter on single ids reads
    their buckets alone. The rows of an id share a bucket, one file each; NULL ids share one too.
    """
    (
        table.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.page.row.count.limit", ROWS_PER_PAGE)
        .option("path", path)
        .saveAsTable(name)
    )
    return table.sparkSession.table(name)


def article_texts(articles: DataFrame) -> DataFrame:
    """What embedding needs of the article table: ids, titles and abstracts."""
    return articles.select("pmid", "title", "abstract")
