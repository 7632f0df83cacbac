"""Int8 codes: range, quantizing, and searching them."""

from pyspark.sql import functions as F

from vectrail.operators import quantize
from vectrail.operators.batch_search import search_batch
from vectrail.operators.refine import refinable_codes, search_refined
from vectrail.operators.search import search
from vectrail.plans.build import build_codes
from vectrail.plans.catalog.registry import query
from vectrail.plans.catalog.scoring import PRODUCT_CLAMP
from vectrail.plans.catalog.standins import (
    QUERY_SQL,
    STRETCHED_SQL,
    first_vector,
    long_form,
    stretched_vectors,
)
from vectrail.scratch import new_path

_K = 10
_RANGE_SQL = """b AS (SELECT min(list_min(doc_vector))::FLOAT AS lo, max(list_max(doc_vector))::FLOAT AS hi
    FROM v)"""
_CODES_SQL = f"""{STRETCHED_SQL}, {_RANGE_SQL},
    c AS (SELECT doc_id, label, [
        trunc((x - lo) / (hi - lo) * 255::FLOAT - 128::FLOAT)::TINYINT
        FOR x IN doc_vector::FLOAT[]] AS codes FROM v, b)"""

_RANGE = f"WITH {STRETCHED_SQL}, {_RANGE_SQL} SELECT lo::DOUBLE AS min_val, hi::DOUBLE AS max_val FROM b"


@query(_RANGE)
def vector_range(spark, sf_dir):
    return quantize.vector_range(stretched_vectors(spark, sf_dir))


@query(_RANGE)
def range_stats(spark, sf_dir):
    """Computed and saved by the first call, and only loaded by the second."""
    path = new_path(spark, "range")
    table = stretched_vectors(spark, sf_dir)
    quantize.range_stats(table, path)
    return quantize.range_stats(table.limit(0), path)


_LONG_CODES = f"""WITH {_CODES_SQL}
    SELECT doc_id, (generate_subscripts(codes, 1) - 1)::INTEGER AS dim, unnest(codes)::INTEGER AS value
    FROM c"""


@query(_LONG_CODES)
def quantize_int8(spark, sf_dir):
    """Codes by the column expression."""
    table = stretched_vectors(spark, sf_dir)
    codes = quantize.quantize_table(table, quantize.vector_range(table), engine="expr")
    return long_form(codes, "cast(value AS int)")


@query(
    f"""WITH {_CODES_SQL} SELECT doc_id, label, array_to_string(codes, ',') AS codes FROM c"""
)
def quantize_table(spark, sf_dir):
    """The stored int8 table, written by the batch job."""
    table = stretched_vectors(spark, sf_dir)
    codes = build_codes(table, new_path(spark, "codes"), new_path(spark, "range"))
    return codes.select(
        "doc_id", "label", F.array_join(F.col("doc_vector").cast("array<string>"), ",").alias("codes")
    )


_CODE_HITS = f"""{_CODES_SQL}, {QUERY_SQL},
    w AS (SELECT doc_id, label, codes::DOUBLE[] AS doc_vector FROM c),
    s AS (SELECT doc_id, label, round({PRODUCT_CLAMP}, 12) AS s FROM w, q),
    h AS (SELECT doc_id, label, s FROM s ORDER BY s DESC, doc_id LIMIT {_K})"""


def _code_hits(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    codes = quantize.quantize_table(table, quantize.vector_range(table))
    return search(codes, first_vector(table), _K)


@query(f"WITH {_CODE_HITS} SELECT doc_id, label, round(s, 6) AS similarity FROM h")
def topk_int8(spark, sf_dir):
    return _code_hits(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


_BATCH_SQL = f"""{_CODES_SQL},
    w AS (SELECT doc_id, codes::DOUBLE[] AS doc_vector FROM c),
    q AS (SELECT doc_id AS query_id, doc_vector AS qv FROM v WHERE doc_id % 50 = 0),
    es AS (SELECT query_id, doc_id, round({PRODUCT_CLAMP}, 12) AS s FROM v, q),
    cs AS (SELECT query_id, doc_id, round({PRODUCT_CLAMP}, 12) AS s FROM w, q),
    er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM es),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM cs)"""


@query(
    f"""WITH {_BATCH_SQL}
    SELECT er.query_id, count(*) AS hits, count(cr.doc_id) AS found,
           count(cr.doc_id) / count(*) AS recall
    FROM er LEFT JOIN (SELECT * FROM cr WHERE r <= {_K}) cr USING (query_id, doc_id)
    WHERE er.r <= {_K} GROUP BY er.query_id"""
)
def batch_recall(spark, sf_dir):
    """Of every fiftieth vector's hits, the share that a search over codes finds, for each of them."""
    table = stretched_vectors(spark, sf_dir)
    codes = quantize.quantize_table(table, quantize.vector_range(table))
    queries = table.where("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "doc_vector AS query_vector")
    return quantize.recall_at_k(
        search_batch(table, queries, _K), search_batch(codes, queries, _K), per_query=True
    )


@query(
    f"""WITH {_CODE_HITS},
    fs AS (SELECT doc_id, round({PRODUCT_CLAMP}, 12) AS s FROM v, q),
    f AS (SELECT doc_id FROM fs ORDER BY s DESC, doc_id LIMIT {_K})
    SELECT count(*) AS hits, count(h.doc_id) AS found, count(h.doc_id) / count(*) AS recall
    FROM f LEFT JOIN h USING (doc_id)"""
)
def recall_at_k(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    return quantize.recall_at_k(
        search(table, first_vector(table), _K), _code_hits(spark, sf_dir)
    )


@query(
    f"""WITH {STRETCHED_SQL}, {QUERY_SQL},
    s AS (SELECT doc_id, label, round({PRODUCT_CLAMP}, 12) AS s FROM v, q)
    SELECT doc_id, label, round(s, 6) AS similarity FROM s ORDER BY s DESC, doc_id LIMIT {_K}"""
)
def topk_refined(spark, sf_dir):
    """The exact nearest by their codes; only rows that these cannot rule out are read as floats."""
    table = stretched_vectors(spark, sf_dir)
    stats = quantize.range_stats(table, new_path(spark, "range"))
    refinable_codes(table, stats).write.parquet(path := new_path(spark, "codes"))
    found = search_refined(spark.read.parquet(path), table, first_vector(table), stats, _K)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {STRETCHED_SQL},
    e AS (SELECT doc_id, generate_subscripts(doc_vector, 1) - 1 AS dim, unnest(doc_vector)::FLOAT AS x FROM v),
    b AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM e GROUP BY dim)
    SELECT doc_id, dim::INTEGER AS dim, trunc((x - lo) / (hi - lo) * 255::FLOAT - 128::FLOAT)::INTEGER AS value
    FROM e JOIN b USING (dim)"""
)
def quantize_per_dim(spark, sf_dir):
    """Codes over the range of each place, which is saved with the table's fingerprint."""
    table, path = stretched_vectors(spark, sf_dir), new_path(spark, "ranges")
    quantize.save_dimension_ranges(table, path)
    codes = quantize.quantize_per_dimension(table, quantize.load_dimension_ranges(table, path))
    return long_form(codes, "cast(value AS int)")
