"""Top-k searches."""

from pyspark.sql import functions as F

from vectrail.functions.sql import register_sql
from vectrail.operators.batch_search import Rounds, search_batch
from vectrail.operators.blocks import search_blocks, write_blocks
from vectrail.operators.embedding import hashing_model
from vectrail.operators.lookup import attach_documents, lookup
from vectrail.operators.profile import with_norm
from vectrail.operators.search import score_table, search, with_rank
from vectrail.plans.build import build_vectors
from vectrail.plans.catalog.registry import query
from vectrail.plans.catalog.scoring import DOC_CLAMP, PRODUCT_CLAMP
from vectrail.plans.catalog.standins import (
    ARTICLES_SQL,
    QUERY_SQL,
    STRETCHED_SQL,
    articles,
    first_vector,
    stretched_vectors,
)
from vectrail.plans.retriever import Retriever
from vectrail.scratch import new_path
from vectrail.sources.tables import read_vectors, write_bucketed, write_vectors
from vectrail.streaming.topk import follow_topk, read_topk

_K = 10
# The dimension of the built-in model in these queries.
DIM = 64


def _hits(score: str, source: str = "v") -> str:
    return f"""{STRETCHED_SQL}, {QUERY_SQL},
        s AS (SELECT doc_id, label, round({score}, 12) AS s FROM {source}, q),
        h AS (SELECT doc_id, label, s, row_number() OVER (ORDER BY s DESC, doc_id) AS rank
              FROM s ORDER BY s DESC, doc_id LIMIT {_K})"""


def _rounded(hits):
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_hits(PRODUCT_CLAMP)} SELECT doc_id, label, round(s, 6) AS similarity FROM h")
def topk_search(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    return _rounded(search(table, first_vector(table), _K))


@query(
    f"WITH {_hits(PRODUCT_CLAMP)} SELECT doc_id, label, round(s, 6) AS similarity FROM h",
)
def topk_packed(spark, sf_dir):
    """The same search over a stored table of packed vectors."""
    table, path = stretched_vectors(spark, sf_dir), new_path(spark, "packed")
    write_vectors(table, path, packed=True)
    return _rounded(search(read_vectors(spark, path), first_vector(table), _K))


@query(f"WITH {_hits(PRODUCT_CLAMP)} SELECT doc_id, label, round(s, 6) AS similarity FROM h")
def topk_block_skip(spark, sf_dir):
    """The same search over a table stored in blocks of similar vectors, most of them never read."""
    table = stretched_vectors(spark, sf_dir)
    stored, sidecar = new_path(spark, "blocks"), new_path(spark, "sidecar")
    write_blocks(table, stored, sidecar, rows_per_block=16, centres=32)
    return _rounded(search_blocks(spark, stored, sidecar, first_vector(table), _K))


@query(f"WITH {_hits(DOC_CLAMP)} SELECT doc_id, label, round(s, 6) AS similarity FROM h")
def topk_doc_clamp(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    return _rounded(search(table, first_vector(table), _K, clamp="doc", engine="expr"))


@query(
    f"WITH {_hits('list_dot_product(doc_vector, qv)')} "
    "SELECT doc_id, label, round(s, 6) AS similarity FROM h"
)
def topk_dot(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    return _rounded(search(table, first_vector(table), _K, metric="dot"))


@query(
    f"WITH {_hits(PRODUCT_CLAMP)} "
    "SELECT rank::INTEGER AS rank, doc_id, round(s, 6) AS similarity FROM h"
)
def ranked_results(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    return _rounded(with_rank(search(table, first_vector(table), _K))).drop("label")


_HALF = """(SELECT * FROM v ORDER BY doc_id
    LIMIT (SELECT CAST((count(*) + 1) // 2 AS BIGINT) FROM embeddings))"""


@query(
    f"WITH {_hits(PRODUCT_CLAMP, _HALF)} SELECT doc_id, label, round(s, 6) AS similarity FROM h"
)
def topk_capped(spark, sf_dir):
    """A search restricted to the first half of the table."""
    table = stretched_vectors(spark, sf_dir)
    half = (table.count() + 1) // 2
    return _rounded(search(table, first_vector(table), _K, num_records=half))


@query(
    f"""WITH {STRETCHED_SQL},
    e AS (SELECT label, generate_subscripts(doc_vector, 1) AS dim, unnest(doc_vector) AS x FROM v),
    c AS (SELECT label, dim, avg(x) AS x FROM e GROUP BY label, dim),
    q AS (SELECT label AS query_id, list(x ORDER BY dim) AS qv FROM c GROUP BY label),
    s AS (SELECT query_id, doc_id, round({PRODUCT_CLAMP}, 12) AS s FROM v, q),
    r AS (SELECT query_id, doc_id, s,
                 row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, doc_id, round(s, 6) AS similarity
    FROM r WHERE rank <= {_K}"""
)
def batch_topk(spark, sf_dir):
    """The vectors nearest to the mean vector of each label."""
    table = stretched_vectors(spark, sf_dir)
    means = (
        table.selectExpr("label AS query_id", "posexplode(doc_vector) AS (dim, x)")
        .groupBy("query_id", "dim")
        .agg(F.avg("x").alias("x"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("elements"))
        .select("query_id", F.col("elements.x").alias("query_vector"))
    )
    return _rounded(search_batch(table, means, _K))


@query(
    f"""WITH {STRETCHED_SQL},
    q AS (SELECT doc_id AS query_id, doc_vector AS qv FROM v WHERE doc_id % 100 = 0),
    s AS (SELECT query_id, doc_id, round({PRODUCT_CLAMP}, 12) AS s FROM v, q),
    r AS (SELECT query_id, doc_id, s,
                 row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, doc_id, round(s, 6) AS similarity
    FROM r WHERE rank <= {_K}"""
)
def stream_topk(spark, sf_dir):
    """Every hundredth vector's nearest, kept while the table arrives in three waves of files."""
    table = stretched_vectors(spark, sf_dir)
    queries = table.where("doc_id % 100 = 0").selectExpr("doc_id AS query_id", "doc_vector AS query_vector")
    source, checkpoint, output = (new_path(spark, n) for n in ("arriving", "checkpoint", "best"))
    for wave in range(3):
        write_vectors(table.where(F.pmod("doc_id", F.lit(3)) == wave), source, mode="append")
        follow_topk(spark, source, queries, _K, checkpoint, output)
    return _rounded(read_topk(spark, queries, output))


@query(
    f"""WITH {STRETCHED_SQL}, {QUERY_SQL},
    s AS (SELECT doc_id, label, round({PRODUCT_CLAMP}, 12) AS s FROM v, q),
    h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, doc_id) AS rank FROM s)
    SELECT h.doc_id, h.label, round(s, 6) AS similarity, round(sqrt(list_dot_product(doc_vector, doc_vector)), 6) AS norm
    FROM h JOIN v USING (doc_id) WHERE rank <= 3"""
)
def sql_vector_topk(spark, sf_dir):
    """The three vectors of each label nearest to vector 0 and their lengths, in SQL alone."""
    register_sql(spark)
    return spark.sql(
        f"""WITH v AS (
            SELECT vec_id AS doc_id, label, transform(embedding, x -> float(x * (1 + label))) AS doc_vector
            FROM parquet.`{sf_dir}/embeddings.parquet`),
        h AS (
            SELECT * FROM vector_topk(
                TABLE(SELECT * FROM v) PARTITION BY (label), (SELECT doc_vector FROM v WHERE doc_id = 0), 3))
        SELECT h.doc_id, h.label, round(similarity, 6) AS similarity, round(vector_norm(doc_vector), 6) AS norm
        FROM h JOIN v USING (doc_id)"""
    )


@query(
    f"""WITH {STRETCHED_SQL},
    q AS (SELECT doc_id AS query_id, doc_vector AS qv FROM v WHERE doc_id % 20 = 0),
    s AS (SELECT query_id, doc_id, round({PRODUCT_CLAMP}, 12) AS s FROM v, q),
    r AS (SELECT query_id, doc_id, s,
                 row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, doc_id, round(s, 6) AS similarity
    FROM r WHERE rank <= {_K}"""
)
def batch_topk_bounded(spark, sf_dir):
    """Every twentieth vector's nearest, in rounds that start from the best of the earlier ones."""
    table = with_norm(stretched_vectors(spark, sf_dir))
    queries = table.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "doc_vector AS query_vector")
    return _rounded(search_batch(table, queries, _K, norm_column="norm", rounds=Rounds(first_rows=64)))


@query(
    f"""WITH {_hits(PRODUCT_CLAMP)}, {ARTICLES_SQL}
    SELECT pmid, title, authors, abstract, publication_year FROM a
    WHERE doc_id IN (SELECT doc_id FROM h)"""
)
def document_lookup(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    hits = search(table, first_vector(table), _K)
    return lookup(articles(spark, sf_dir), hits).drop("doc_id")


_WITH_DOCUMENTS = f"""WITH {_hits(PRODUCT_CLAMP)}, {ARTICLES_SQL}
    SELECT h.rank::INTEGER AS rank, h.doc_id, h.label, round(h.s, 6) AS similarity,
           pmid, title, authors, abstract, publication_year
    FROM h LEFT JOIN a USING (doc_id)"""


@query(_WITH_DOCUMENTS)
def search_with_documents(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    hits = with_rank(search(table, first_vector(table), _K))
    return _rounded(attach_documents(hits, articles(spark, sf_dir)))


@query(
    f"""WITH {STRETCHED_SQL}, {QUERY_SQL}, {ARTICLES_SQL}
    SELECT v.doc_id, label, round(round({PRODUCT_CLAMP}, 12), 6) AS similarity, pmid, title, publication_year
    FROM v CROSS JOIN q LEFT JOIN a ON a.doc_id = v.doc_id"""
)
def colocated_documents(spark, sf_dir):
    """Every vector's score beside its article, from tables in equal buckets that need no exchange."""
    table, buckets = stretched_vectors(spark, sf_dir), 8

    def stored(df, name):
        path = new_path(spark, name)
        return write_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets)

    texts = stored(articles(spark, sf_dir), "articles").select("doc_id", "pmid", "title", "publication_year")
    joined = stored(table, "vectors").join(texts, "doc_id", "left")
    return _rounded(score_table(joined, first_vector(table)))


def hashed_sql(name: str, source: str, key: str) -> str:
    """Common table expressions for the non-zero elements of hashed texts, in ``name``."""
    return rf"""{name}_tokens AS (
        SELECT {key}, unnest(
            [x FOR x IN string_split_regex(lower(text), '[ \t\n\r\f\v]+') IF x <> '']) AS token
        FROM {source}),
    {name}_sizes AS (SELECT {key}, count(*) AS n FROM {name}_tokens GROUP BY {key}),
    {name}_places AS (
        SELECT {key}, (('0x' || substr(md5(token), 1, 8))::BIGINT % {DIM})::INTEGER AS dim,
               1 - 2 * (('0x' || substr(md5(token), 9, 1))::BIGINT % 2) AS sign
        FROM {name}_tokens),
    {name} AS (
        SELECT {key}, dim, ((sum(sign) / any_value(n))::FLOAT)::DOUBLE AS value
        FROM {name}_places JOIN {name}_sizes USING ({key}) GROUP BY {key}, dim
        HAVING sum(sign) <> 0)"""


@query(
    rf"""WITH {ARTICLES_SQL},
    x AS (SELECT doc_id, 'search_document: ' ||
            CASE WHEN regexp_matches(abstract, '\S') THEN abstract ELSE title END AS text FROM a),
    b AS (SELECT item_id, text FROM benchmark),
    {hashed_sql("dv", "x", "doc_id")}, {hashed_sql("qv", "b", "item_id")},
    dn AS (SELECT doc_id, sqrt(sum(value * value)) AS dn FROM dv GROUP BY doc_id),
    qn AS (SELECT item_id, sqrt(sum(value * value)) AS qn FROM qv GROUP BY item_id),
    p AS (SELECT item_id, doc_id, sum(dv.value * qv.value) AS dot
          FROM dv JOIN qv USING (dim) GROUP BY item_id, doc_id),
    s AS (SELECT item_id AS query_id, doc_id,
                 round(coalesce(dot, 0) / greatest(coalesce(dn, 0) * coalesce(qn, 0), 1e-5), 12) AS s
          FROM b CROSS JOIN x LEFT JOIN p USING (item_id, doc_id)
          LEFT JOIN dn USING (doc_id) LEFT JOIN qn USING (item_id)),
    r AS (SELECT query_id, doc_id, s,
                 row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, doc_id, round(s, 6) AS similarity, pmid, title,
           authors, abstract, publication_year
    FROM r JOIN a USING (doc_id) WHERE rank <= 5"""
)
def retrieve_documents(spark, sf_dir):
    """Every benchmark text against all articles: embed both, search, look the articles up."""
    table = articles(spark, sf_dir)
    model = hashing_model(DIM)
    stored = build_vectors(table, model, new_path(spark, "vectors"), rebalance=True)
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = queries.select(F.col("item_id").alias("query_id"), "text")
    return _rounded(Retriever(stored, table, model).search_many(texts, 5))
