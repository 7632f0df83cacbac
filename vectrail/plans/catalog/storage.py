"""Vector tables in and out of storage."""

from pyspark.sql import functions as F

from vectrail.operators.fingerprint import same_content
from vectrail.operators.profile import check_dim, pair_counts
from vectrail.plans.catalog.registry import query
from vectrail.plans.catalog.standins import VECTORS_SQL, long_form, vectors
from vectrail.scratch import new_path
from vectrail.sources.raw_pair_source import NAME, register
from vectrail.sources.raw_pairs import pair_files, read_raw_pair, write_raw_pair
from vectrail.sources.tables import read_vectors, write_vectors

_LONG = f"""WITH {VECTORS_SQL}
    SELECT doc_id, (generate_subscripts(doc_vector, 1) - 1)::INTEGER AS dim,
           round(unnest(doc_vector)::DOUBLE, 6) AS value FROM v"""


@query(_LONG)
def vector_scan(spark, sf_dir):
    return long_form(vectors(spark, sf_dir))


@query(
    f"""WITH {VECTORS_SQL} SELECT doc_id, label, len(doc_vector)::INTEGER AS dim,
        round(list_sum(doc_vector::DOUBLE[]), 6) AS total FROM v"""
)
def vector_sink(spark, sf_dir):
    path = new_path(spark, "vectors")
    write_vectors(vectors(spark, sf_dir), path)
    total = F.aggregate("doc_vector", F.lit(0.0), lambda total, x: total + x.cast("double"))
    return read_vectors(spark, path).select(
        "doc_id", "label", F.array_size("doc_vector").alias("dim"), F.round(total, 6).alias("total")
    )


def _raw_pair(spark, sf_dir):
    """The vector table written as raw pairs, in as many files as its scan has tasks."""
    folders = new_path(spark, "raw-vectors"), new_path(spark, "raw-ids")
    write_raw_pair(vectors(spark, sf_dir), *folders)
    return *folders, check_dim(vectors(spark, sf_dir))


@query(_LONG)
def raw_vector_import(spark, sf_dir):
    return long_form(read_raw_pair(spark, *_raw_pair(spark, sf_dir)))


@query("SELECT count(*) AS n_ids, count(*) AS n_vectors, true AS matched FROM embeddings")
def pair_count_check(spark, sf_dir):
    """Counts from the sizes of the files alone."""
    files = pair_files(spark, *_raw_pair(spark, sf_dir))
    counted = files.agg(F.sum("n_ids").alias("n_ids"), F.sum("n_rows").alias("n_vectors"))
    return counted.withColumn("matched", F.col("n_ids") == F.col("n_vectors"))


@query("SELECT count(*) AS n_ids, count(*) AS n_vectors, true AS matched FROM embeddings")
def pair_count_scan(spark, sf_dir):
    """Counts of two tables by reading them."""
    table = vectors(spark, sf_dir)
    return pair_counts(table.select("doc_id"), table.select("doc_vector"))


@query(_LONG)
def raw_pairs_source(spark, sf_dir):
    """The same import through the data source: written, committed and read by its format."""
    register(spark)
    table, path = vectors(spark, sf_dir), new_path(spark, "raw-pairs")
    writer = table.select("doc_id", "doc_vector").write.format(NAME).option("path", path)
    writer.option("dim", check_dim(table)).mode("append").save()
    return long_form(spark.read.format(NAME).option("path", path).load())


@query("SELECT count(*) AS n_rows, count(*) AS n_other, true AS matched FROM embeddings")
def pair_fingerprint(spark, sf_dir):
    """Whether an imported raw pair holds what the table holds, bit by bit, without a join of rows."""
    return same_content(vectors(spark, sf_dir), read_raw_pair(spark, *_raw_pair(spark, sf_dir)))
