"""From raw XML to the article table."""

from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.operators import dedup
from vectrail.plans.build import build_articles
from vectrail.plans.catalog.registry import query
from vectrail.plans.catalog.standins import (
    ARTICLES_SQL,
    RAW_FIELDS_SQL,
    articles,
    raw_fields,
    write_xml,
)
from vectrail.scratch import new_path
from vectrail.sources.article_xml import (
    SOURCE_ORDER,
    positioned,
    read_articles,
    record_columns,
    record_options,
)
from vectrail.sources.tables import article_texts, read_articles_table, write_articles
from vectrail.streaming.incremental import ingest_new_files, merge_batches, read_ingested

_YEAR_RAW = 'coalesce(nullif("year", \'\'), substr(medline_date, 1, 4))'
# The title in the XML goes on with an inline element; what precedes that is the title's text.
_TITLE = r"rtrim(title, ' ' || chr(10))"

_FROM_XML = f"""WITH {RAW_FIELDS_SQL}
    SELECT pmid, doc_id, {_TITLE} AS title, authors, abstract,
           try_cast({_YEAR_RAW} AS INTEGER) AS publication_year,
           {_YEAR_RAW} AS publication_year_raw
    FROM r WHERE title <> '' OR coalesce(abstract, '') <> ''"""


def _trimmed(table):
    return table.withColumn("title", F.regexp_replace("title", r"[ \n]+$", ""))


@query(f"SELECT x.* FROM ({_FROM_XML}) x, (VALUES ('plain'), ('gzip')) copies(kind)")
def xml_articles(spark, sf_dir):
    """All documents written as XML twice, plain and compressed, and read back."""
    path = new_path(spark, "xml")
    fields = raw_fields(spark, sf_dir).drop("doc_id", "lang")
    write_xml(fields, path)
    write_xml(fields, path, compression="gzip")
    return _trimmed(read_articles(spark, path).drop(*SOURCE_ORDER))


_SPACED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(
    f"""WITH {RAW_FIELDS_SQL},
    w AS (
        SELECT *, {_SPACED.format("title")} AS t, {_SPACED.format("abstract")} AS b FROM r),
    f AS (
        SELECT *, trim(t || CASE WHEN doc_id % 3 = 0 THEN ' in vitro' ELSE '' END) AS whole,
               CASE WHEN abstract IS NULL THEN NULL WHEN b = '' THEN 'second section of ' || pmid
                    ELSE b || chr(10) || 'second section of ' || pmid END AS lines
        FROM w)
    SELECT pmid, whole AS title, lines AS abstract, authors FROM f WHERE whole <> '' OR lines IS NOT NULL"""
)
def xml_full_text(spark, sf_dir):
    """Whole titles, markup included, and all sections of the abstracts."""
    path = new_path(spark, "xml")
    write_xml(raw_fields(spark, sf_dir).drop("doc_id", "lang"), path)
    return read_articles(spark, path, text_mode="full").select("pmid", "title", "abstract", "authors")


@query(
    """SELECT lang, suffix, count(*) AS n_records
    FROM documents, (VALUES ('xml'), ('xml.gz')) s(suffix) GROUP BY lang, suffix"""
)
def file_select(spark, sf_dir):
    """Records per language and kind of file; files of other names in the folder are not read."""
    path = new_path(spark, "xml")
    fields = raw_fields(spark, sf_dir).drop("doc_id")
    write_xml(fields, path, by="lang")
    write_xml(fields, path, compression="gzip", by="lang")
    decoys = fields.select("lang", F.concat(F.lit("<PubmedArticle>"), "title").alias("value"))
    decoys.write.mode("append").partitionBy("lang").text(path)
    # The folders make the language a column beside the text of each record.
    lines = spark.read.options(**record_options()).text(path).select("lang", *record_columns())
    suffix = F.regexp_extract("source_file", r"\.(xml|xml\.gz)$", 1).alias("suffix")
    records = positioned(lines).select("lang", suffix)
    return records.groupBy("lang", "suffix").agg(F.count("*").alias("n_records"))


@query(f"WITH {ARTICLES_SQL} SELECT pmid, title, abstract FROM a")
def article_projection(spark, sf_dir):
    return article_texts(articles(spark, sf_dir))


@query(
    f"""WITH {ARTICLES_SQL} SELECT pmid, doc_id, title, authors, abstract, publication_year,
        publication_year::VARCHAR AS publication_year_raw FROM a"""
)
def article_sink(spark, sf_dir):
    path = new_path(spark, "articles")
    write_articles(articles(spark, sf_dir), path)
    return read_articles_table(spark, path)


# Fields that are missing, empty or there, by remainders of the id.
_GAPS = [
    "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN NULL ELSE pmid END AS pmid",
    "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE title END AS title",
    "CASE WHEN doc_id % 2 = 0 THEN '' ELSE abstract END AS abstract",
]


@query(
    f"""WITH {RAW_FIELDS_SQL}, g AS (SELECT doc_id, {", ".join(_GAPS)} FROM r)
    SELECT doc_id, pmid, title, abstract FROM g
    WHERE pmid <> '' AND coalesce(nullif(title, ''), nullif(abstract, '')) IS NOT NULL"""
)
def valid_articles(spark, sf_dir):
    table = raw_fields(spark, sf_dir).selectExpr("doc_id", *_GAPS)
    return table.where(X.is_valid_article(F.col("pmid"), F.col("title"), F.col("abstract")))


@query(
    f"""WITH {RAW_FIELDS_SQL} SELECT doc_id, {_YEAR_RAW} AS publication_year_raw,
        try_cast({_YEAR_RAW} AS INTEGER) AS publication_year FROM r"""
)
def publication_year(spark, sf_dir):
    year, date = F.col("year"), F.col("medline_date")
    return raw_fields(spark, sf_dir).select(
        "doc_id",
        X.publication_year_raw(year, date).alias("publication_year_raw"),
        X.publication_year(year, date).alias("publication_year"),
    )


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ''
        ELSE lang || ' ' || source || ', ' || source || ' ' || lang END AS authors
    FROM documents"""
)
def author_list(spark, sf_dir):
    """Two full names with a collective name between them, or a collective name alone."""
    person = "named_struct('fore_name', {0}, 'last_name', {1})"
    collective = person.format("cast(NULL AS string)", "source")
    several = ", ".join([person.format("lang", "source"), collective, person.format("source", "lang")])
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id", f"if(doc_id % 4 = 0, array({collective}), array({several})) AS authors"
    )
    return table.select("doc_id", X.author_list(F.col("authors")).alias("authors"))


def _copies(spark, sf_dir):
    """Every article in two files; every third one is in the earlier file under another title."""
    table = articles(spark, sf_dir).select("pmid", "title", "doc_id")
    later = table.withColumn("title", F.concat(F.lit("later copy of "), "title"))
    return table.selectExpr(
        "pmid", "title", "if(doc_id % 3 = 0, 'b.xml', 'a.xml') AS source_file", "doc_id AS source_row"
    ).unionAll(
        later.selectExpr(
            "pmid", "title", "if(doc_id % 3 = 0, 'a.xml', 'b.xml') AS source_file", "doc_id + 1"
        )
    )


@query(
    f"""WITH {ARTICLES_SQL} SELECT pmid, source_file, title FROM (
        SELECT pmid, 'a.xml' AS source_file,
            CASE WHEN doc_id % 3 = 0 THEN 'later copy of ' || title ELSE title END AS title FROM a)"""
)
def dedup_first_wins(spark, sf_dir):
    kept = dedup.first_wins(_copies(spark, sf_dir), "pmid", ["source_file", "source_row"])
    return kept.select("pmid", "source_file", "title")


@query(
    f"""WITH {ARTICLES_SQL}
    SELECT pmid, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'stored' WHEN doc_id % 3 = 0
        THEN 'later copy of ' || title ELSE title END AS title FROM a"""
)
def upsert_ignore(spark, sf_dir):
    """The articles that have labels are stored already and must not change."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stored = labels.select(F.col("doc_id").cast("string").alias("pmid"), F.lit("stored").alias("title"))
    return dedup.upsert_ignore(stored, _copies(spark, sf_dir), "pmid", ["source_file", "source_row"])


@query(
    f"""WITH {RAW_FIELDS_SQL}, w AS (
        SELECT pmid, title, abstract FROM r
        UNION ALL SELECT 'new' || pmid, 'second wave', abstract FROM r)
    SELECT pmid, rtrim(title, ' ' || chr(10)) AS title, abstract FROM w
    WHERE title <> '' OR coalesce(abstract, '') <> ''"""
)
def incremental_ingest(spark, sf_dir):
    """Two waves of files and a run without new ones. The second repeats all ids of the first."""
    source, table, checkpoint = (new_path(spark, n) for n in ("source", "ingested", "ledger"))
    first = raw_fields(spark, sf_dir).drop("doc_id", "lang")
    again = first.withColumn("title", F.lit("second wave"))
    fresh = again.withColumn("pmid", F.concat(F.lit("new"), "pmid"))
    write_xml(first, source, compression="gzip")
    ingest_new_files(spark, source, table, checkpoint)
    write_xml(again.unionByName(fresh), source)
    ingest_new_files(spark, source, table, checkpoint)
    ingest_new_files(spark, source, table, checkpoint)
    return _trimmed(read_ingested(spark, table).select("pmid", "title", "abstract"))


@query(
    f"""WITH {RAW_FIELDS_SQL}, w AS (
        SELECT pmid, title, abstract FROM r
        UNION ALL SELECT 'new' || pmid, 'other source', abstract FROM r)
    SELECT pmid, rtrim(title, ' ' || chr(10)) AS title, abstract FROM w
    WHERE title <> '' OR coalesce(abstract, '') <> ''"""
)
def incremental_two_sources(spark, sf_dir):
    """Two sources with ledgers of their own fill one table, then one of them loses its ledger."""
    names = ("source", "source", "ingested", "ledger", "ledger", "ledger")
    here, there, table, one, two, three = (new_path(spark, n) for n in names)
    first = raw_fields(spark, sf_dir).drop("doc_id", "lang")
    again = first.withColumn("title", F.lit("other source"))
    write_xml(first, here)
    write_xml(again.unionByName(again.withColumn("pmid", F.concat(F.lit("new"), "pmid"))), there)
    for source, ledger in ((here, one), (there, two), (here, three)):
        ingest_new_files(spark, source, table, ledger)
    return _trimmed(read_ingested(spark, table).select("pmid", "title", "abstract"))


@query(
    f"""WITH {RAW_FIELDS_SQL}, w AS (
        SELECT pmid, title, abstract FROM r
        UNION ALL SELECT 'new' || pmid, 'second wave', abstract FROM r
        UNION ALL SELECT 'last' || pmid, 'third wave', abstract FROM r)
    SELECT pmid, rtrim(title, ' ' || chr(10)) AS title, abstract FROM w
    WHERE title <> '' OR coalesce(abstract, '') <> ''"""
)
def incremental_merge(spark, sf_dir):
    """Three waves that repeat all earlier ids; the batches before each are merged into one folder."""
    source, table, ledger = (new_path(spark, n) for n in ("source", "ingested", "ledger"))
    first = raw_fields(spark, sf_dir).drop("doc_id", "lang")
    seen = first
    write_xml(first, source, compression="gzip")
    for wave, prefix in (("second wave", "new"), ("third wave", "last")):
        ingest_new_files(spark, source, table, ledger, max_files_per_batch=8)
        merge_batches(spark, table)
        again = seen.withColumn("title", F.lit(wave))
        fresh = first.withColumn("title", F.lit(wave)).withColumn("pmid", F.concat(F.lit(prefix), "pmid"))
        seen = again.unionByName(fresh)
        write_xml(seen, source, compression="gzip")
    ingest_new_files(spark, source, table, ledger)
    merge_batches(spark, table)
    return _trimmed(read_ingested(spark, table).select("pmid", "title", "abstract"))


@query(
    f"""WITH {RAW_FIELDS_SQL}, w AS (
        SELECT pmid, title, abstract FROM r UNION ALL SELECT 'new' || pmid, title, abstract FROM r)
    SELECT pmid, rtrim(title, ' ' || chr(10)) AS title, abstract FROM w
    WHERE title <> '' OR coalesce(abstract, '') <> ''"""
)
def ingest_clean_source(spark, sf_dir):
    """Files are deleted once their batch is committed; the table keeps what they held."""
    source, table, ledger = (new_path(spark, n) for n in ("source", "ingested", "ledger"))
    first = raw_fields(spark, sf_dir).drop("doc_id", "lang")
    for wave in (first, first.withColumn("pmid", F.concat(F.lit("new"), "pmid"))):
        write_xml(wave, source)
        ingest_new_files(spark, source, table, ledger, clean_source="delete")
    return _trimmed(read_ingested(spark, table).select("pmid", "title", "abstract"))


@query(
    f"""WITH {RAW_FIELDS_SQL}, w AS (SELECT pmid, doc_id, title, abstract, authors FROM r)
    SELECT pmid, doc_id, {_TITLE} AS title, authors, abstract FROM w
    WHERE title <> '' OR coalesce(abstract, '') <> ''"""
)
def build_article_table(spark, sf_dir):
    """The batch job: all documents twice in XML, each once in the table."""
    path = new_path(spark, "xml")
    fields = raw_fields(spark, sf_dir).drop("doc_id", "lang")
    write_xml(fields, path)
    write_xml(fields, path, compression="gzip")
    table = build_articles(spark, path, new_path(spark, "articles"))
    return _trimmed(table.select("pmid", "doc_id", "title", "authors", "abstract"))
