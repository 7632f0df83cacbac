"""Text to vectors."""

from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.operators import embedding, pooling
from vectrail.plans.catalog.registry import query
from vectrail.plans.catalog.searching import DIM, hashed_sql
from vectrail.plans.catalog.standins import (
    ARTICLES_SQL,
    TOKENS_SQL,
    articles,
    documents,
    long_form,
    token_vectors,
)

_TEXT = r"CASE WHEN regexp_matches(abstract, '\S') THEN abstract ELSE title END"


@query(f"WITH {ARTICLES_SQL} SELECT doc_id, 'search_document: ' || {_TEXT} AS text FROM a")
def embed_input(spark, sf_dir):
    return embedding.embedding_input(articles(spark, sf_dir))


@query(
    f"""WITH {ARTICLES_SQL}
    SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id, count(*) AS n,
           min(CASE WHEN doc_id % 7 <> 0 THEN {_TEXT} END) AS text
    FROM a GROUP BY ALL"""
)
def embed_bad_ids(spark, sf_dir):
    """Every seventh id is no number: these articles are counted, and the others embedded."""
    pmid = "if(doc_id % 7 = 0, concat('x', pmid), pmid) AS pmid"
    table = articles(spark, sf_dir).selectExpr(pmid, "title", "abstract")
    texts = embedding.embedding_input(table, prefix="", on_bad_id="skip")
    set_aside = embedding.bad_ids(table).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return texts.unionByName(set_aside).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("text"))


@query(
    r"""SELECT doc_id, array_to_string(list_slice(
        [x FOR x IN string_split_regex(text, '\s+') IF x <> ''], 1, 32), ' ') AS text FROM documents"""
)
def truncate_tokens(spark, sf_dir):
    text = X.truncate_tokens(F.col("text"), 32)
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


def _non_zero(table):
    return long_form(table, "round(cast(value AS double), 6)").where("value <> 0")


@query(
    f"""WITH {ARTICLES_SQL}, x AS (SELECT doc_id, 'search_document: ' || {_TEXT} AS text FROM a),
    {hashed_sql("h", "x", "doc_id")}
    SELECT doc_id, dim, round(value, 6) AS value FROM h WHERE round(value, 6) <> 0"""
)
def embed_documents(spark, sf_dir):
    model = embedding.hashing_model(DIM)
    return _non_zero(embedding.embed_articles(articles(spark, sf_dir), model, rebalance=True))


@query(
    f"""WITH {ARTICLES_SQL}, x AS (SELECT doc_id, 'search_document: ' || {_TEXT} AS text FROM a),
    {hashed_sql("h", "x", "doc_id")}
    SELECT doc_id, dim, round(value, 6) AS value FROM h WHERE round(value, 6) <> 0"""
)
def embed_by_length(spark, sf_dir):
    """The same vectors from batches of texts of like length."""
    texts = embedding.embedding_input(articles(spark, sf_dir))
    return _non_zero(embedding.embed_by_length(texts, embedding.hashing_model(DIM), rebalance=True))


@query(
    f"""WITH {hashed_sql("h", "benchmark", "item_id")}
    SELECT item_id AS doc_id, dim, round(value, 6) AS value FROM h WHERE round(value, 6) <> 0"""
)
def embed_queries(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS query_id", "text")
    vectors = embedding.embed_queries(texts, embedding.hashing_model(DIM))
    return _non_zero(vectors.withColumnsRenamed({"query_id": "doc_id", "query_vector": "doc_vector"}))


@query(
    f"""WITH {ARTICLES_SQL} SELECT pmid, doc_id FROM a
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def embed_resume(spark, sf_dir):
    """What remains to do when the articles that have labels are done."""
    done = spark.read.parquet(f"{sf_dir}/labels.parquet")
    todo = embedding.not_embedded(articles(spark, sf_dir), done)
    return todo.select("pmid", "doc_id")


def _pooled(mask: str) -> str:
    return f"""WITH {TOKENS_SQL},
        e AS (SELECT doc_id, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec)::DOUBLE AS x
              FROM t WHERE {mask}),
        m AS (SELECT doc_id, dim::INTEGER AS dim, round(avg(x), 6) AS value
              FROM e GROUP BY doc_id, dim)
        SELECT doc_id, dim, value FROM (SELECT DISTINCT doc_id FROM t) LEFT JOIN m USING (doc_id)"""


@query(_pooled("mask = 1"))
def masked_mean_pool(spark, sf_dir):
    return long_form(pooling.masked_mean_pool(token_vectors(spark, sf_dir), dtype="float64"))


@query(_pooled("true"))
def mean_pool(spark, sf_dir):
    tokens = token_vectors(spark, sf_dir)
    return long_form(pooling.masked_mean_pool(tokens, mask=None, dtype="float64"))
