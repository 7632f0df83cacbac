"""The offline jobs: XML to articles, articles to vectors, vectors to codes."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators.dedup import first_wins
from vectrail.operators.embedding import (
    MakeModel,
    bad_ids,
    embed_articles,
    embed_texts,
    not_embedded,
    numeric_id,
)
from vectrail.operators.quantize import quantize_table, range_stats
from vectrail.schema import DOC_ID, DOC_VECTOR, SOURCE_ORDER, VECTORS
from vectrail.sources.article_xml import read_articles
from vectrail.sources.tables import article_texts, write_articles, write_vectors

#: Below a vector table: the ids that are not numbers. Readers of the table do not see it.
BAD_IDS = "_bad_ids"


def build_articles(
    spark: SparkSession, xml_path: str, table: str, rebalance: bool = False, text_mode: str = "leading"
) -> DataFrame:
    """Write the article table of all XML files below a folder, the first copy of each id."""
    articles = read_articles(spark, xml_path, rebalance=rebalance, text_mode=text_mode)
    write_articles(first_wins(articles, "pmid", SOURCE_ORDER), table)
    return spark.read.parquet(table)


def _check_model(vectors: DataFrame, model: MakeModel) -> None:
    """Fail before any work if the stored vectors have another dimension than the model's."""
    stored = vectors.where(F.col(DOC_VECTOR).isNotNull()).select(F.array_size(DOC_VECTOR)).head()
    if stored is None:
        return
    probe = vectors.sparkSession.createDataFrame([("",)], "text string")
    own = len(embed_texts(probe, model).head()[0])
    if own != stored[0]:
        raise ValueError(f"the model gives {own} dimensions, the table has {stored[0]}")


def build_vectors(
    articles: DataFrame,
    model: MakeModel,
    table: str,
    slices: int = 1,
    on_bad_id: str = "error",
    **options,
) -> DataFrame:
    """Embed the articles that ``table`` has no vector of, and append them.

    The work is done in ``slices`` jobs, each of which is kept once it has finished, so that a run
    that was stopped goes on where it was. An id that is not a number fails the job, or with
    ``on_bad_id='skip'`` its article is set aside: ``{table}/_bad_ids`` has ``(pmid, n)``, the number of
    rows of each such id of the last run.
    """
    spark = articles.sparkSession
    key = numeric_id(on_bad_id)
    if on_bad_id == "skip":
        counted = bad_ids(articles).groupBy("pmid").agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(f"{table}/{BAD_IDS}")
    for number in range(slices):
        try:
            done = spark.read.schema(VECTORS).parquet(table)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            done = spark.createDataFrame([], VECTORS)

        def in_slice(doc_id):
            return F.pmod(F.xxhash64(doc_id), F.lit(slices)) == number

        if number == 0:
            _check_model(done, model)
        part = article_texts(articles).where(in_slice(key))
        todo = not_embedded(part, done.where(in_slice(F.col(DOC_ID))), on_bad_id)
        write_vectors(embed_articles(todo, model, on_bad_id=on_bad_id, **options), table, mode="append")
    return spark.read.schema(VECTORS).parquet(table)


def build_codes(
    vectors: DataFrame, table: str, stats_path: str, mode: str = "reuse"
) -> DataFrame:
    """Write the int8 table of a vector table, over a saved or newly computed range."""
    write_vectors(quantize_table(vectors, range_stats(vectors, stats_path, mode)), table)
    return vectors.sparkSession.read.parquet(table)
