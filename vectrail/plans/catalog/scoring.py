"""Similarity functions over the whole vector table."""

from pyspark.sql import functions as F

from vectrail.functions import similarity
from vectrail.operators.profile import check_dim, table_profile, with_norm
from vectrail.operators.search import score_table, top_k
from vectrail.plans.catalog.registry import query
from vectrail.plans.catalog.standins import (
    QUERY_SQL,
    STRETCHED_SQL,
    VECTORS_SQL,
    first_vector,
    long_form,
    stretched_vectors,
    vectors,
)

_DOT = "list_dot_product(doc_vector, qv)"
_NORM = "sqrt(list_dot_product(doc_vector, doc_vector))"
_QUERY_NORM = "sqrt(list_dot_product(qv, qv))"
DOC_CLAMP = f"{_DOT} / {_QUERY_NORM} / greatest({_NORM}, 1e-5)"
PRODUCT_CLAMP = f"{_DOT} / greatest({_NORM} * {_QUERY_NORM}, 1e-5)"


def _per_row(expression: str, name: str) -> str:
    return f"""WITH {STRETCHED_SQL}, {QUERY_SQL}
        SELECT doc_id, round({expression}, 6) AS {name} FROM v, q"""


@query(_per_row(_DOT, "dot"))
def dot_score(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    scored = score_table(table, first_vector(table), metric="dot", engine="expr", score_name="dot")
    return scored.select("doc_id", F.round("dot", 6).alias("dot"))


@query(_per_row(_NORM, "norm"))
def l2_norm(spark, sf_dir):
    norm = similarity.l2_norm(F.col("doc_vector"))
    return stretched_vectors(spark, sf_dir).select("doc_id", F.round(norm, 6).alias("norm"))


@query(
    f"""WITH {STRETCHED_SQL}, u AS (
        SELECT doc_id, [x / {_NORM} FOR x IN doc_vector] AS n FROM v)
    SELECT doc_id, (generate_subscripts(n, 1) - 1)::INTEGER AS dim, round(unnest(n), 6) AS value
    FROM u"""
)
def l2_normalize(spark, sf_dir):
    unit = similarity.l2_normalize(F.col("doc_vector"))
    return long_form(stretched_vectors(spark, sf_dir).withColumn("doc_vector", unit))


@query(_per_row(DOC_CLAMP, "similarity"))
def cosine_doc_clamp(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    scored = score_table(table, first_vector(table), clamp="doc", engine="expr")
    return scored.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(_per_row(PRODUCT_CLAMP, "similarity"))
def cosine_product_clamp(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    scored = score_table(table, first_vector(table), clamp="product", engine="expr")
    return scored.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {STRETCHED_SQL}, {QUERY_SQL}
    SELECT doc_id, label, round({PRODUCT_CLAMP}, 6) AS cosine_similarity FROM v, q""",
    name="score_table",
)
def scored_rows(spark, sf_dir):
    table = stretched_vectors(spark, sf_dir)
    scored = score_table(table, first_vector(table), score_name="cosine_similarity")
    return scored.withColumn("cosine_similarity", F.round("cosine_similarity", 6))


@query(
    f"""WITH {STRETCHED_SQL}, {QUERY_SQL}, s AS (
        SELECT doc_id, round({PRODUCT_CLAMP}, 12) AS s FROM v, q WHERE label <> 3)
    SELECT doc_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, doc_id LIMIT 10"""
)
def nan_guard(spark, sf_dir):
    """All vectors of label 3 are spoilt by a NaN; none of them may be found."""
    table = stretched_vectors(spark, sf_dir)
    spoilt = F.transform(
        "doc_vector",
        lambda x, i: F.when((i == 0) & (F.col("label") == 3), F.lit(float("nan"))).otherwise(x),
    )
    damaged = table.withColumn("doc_vector", spoilt.cast("array<float>"))
    hits = top_k(score_table(damaged, first_vector(table), on_nan="drop"), 10)
    return hits.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(_per_row(PRODUCT_CLAMP, "similarity"))
def precompute_norms(spark, sf_dir):
    """Scores from stored norms."""
    table = with_norm(stretched_vectors(spark, sf_dir))
    scored = score_table(table, first_vector(table), norm_column="norm")
    return scored.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {VECTORS_SQL} SELECT min(len(doc_vector))::INTEGER AS dim FROM v
    HAVING min(len(doc_vector)) = max(len(doc_vector))"""
)
def vector_dim_check(spark, sf_dir):
    dim = check_dim(vectors(spark, sf_dir))
    return spark.createDataFrame([(dim,)], "dim int")


@query(
    f"""WITH {VECTORS_SQL} SELECT count(*) AS n_rows,
        count(*) FILTER (WHERE doc_vector IS NULL) AS n_missing,
        min(len(doc_vector))::INTEGER AS min_dim, max(len(doc_vector))::INTEGER AS max_dim FROM v""",
    name="table_profile",
)
def profile(spark, sf_dir):
    return table_profile(vectors(spark, sf_dir))
