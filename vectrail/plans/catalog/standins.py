"""The test tables in the shape of vectors, articles and token vectors; in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.sources.tables import read_vectors

# Vectors. The test vectors have length one, which would make cosine and dot product the same, so
# scoring queries stretch them by 1 + label.
VECTORS_SQL = "v AS (SELECT vec_id AS doc_id, embedding AS doc_vector, label FROM embeddings)"
STRETCHED_SQL = """v AS (
    SELECT vec_id AS doc_id, label,
           [(x::DOUBLE * (1 + label))::FLOAT FOR x IN embedding]::DOUBLE[] AS doc_vector
    FROM embeddings)"""
QUERY_SQL = "q AS (SELECT doc_vector AS qv FROM v WHERE doc_id = 0)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_vectors(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding")


def stretched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stretched = F.transform(
        "doc_vector", lambda x: (x.cast("double") * (1 + F.col("label"))).cast("float")
    )
    return vectors(spark, sf_dir).withColumn("doc_vector", stretched)


def first_vector(table: DataFrame) -> list[float]:
    """The vector of id 0, which serves as the query."""
    return table.where("doc_id = 0").select("doc_vector").head()[0]


# Articles made of documents: the first line is the title. Some have no abstract, some a blank one.
ARTICLES_SQL = """a AS (
    SELECT doc_id::VARCHAR AS pmid, doc_id, split_part(text, chr(10), 1) AS title,
           source AS authors,
           CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' ' || chr(9) ELSE text
           END AS abstract,
           (1990 + doc_id % 35)::INTEGER AS publication_year
    FROM documents)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(
        "cast(doc_id AS string) AS pmid",
        "doc_id",
        r"substring_index(text, '\n', 1) AS title",
        "source AS authors",
        r"CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' \t' ELSE text END AS abstract",
        "cast(1990 + doc_id % 35 AS int) AS publication_year",
        "cast(1990 + doc_id % 35 AS string) AS publication_year_raw",
    )


# Raw article fields made of documents, as they would come out of the XML. Characters that XML
# cannot carry are taken out.
RAW_FIELDS_SQL = r"""d AS (
    SELECT doc_id, lang, source,
           regexp_replace(text, '[\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]', '', 'g') AS text
    FROM documents),
r AS (
    SELECT doc_id, doc_id::VARCHAR AS pmid, split_part(text, chr(10), 1) AS title,
           CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS abstract,
           CASE WHEN doc_id % 2 = 0 THEN (1990 + doc_id % 35)::VARCHAR END AS "year",
           CASE WHEN doc_id % 5 = 1 THEN 'Spring'
                WHEN doc_id % 2 = 1 THEN (1990 + doc_id % 35) || ' Dec' END AS medline_date,
           lang || ' ' || source AS authors
    FROM d)"""


def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x{FFFE}\\x{FFFF}]', '') AS text"
    return (
        documents(spark, sf_dir)
        .selectExpr("doc_id", "lang", "source", text)
        .selectExpr(
            "doc_id",
            "cast(doc_id AS string) AS pmid",
            r"substring_index(text, '\n', 1) AS title",
            "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS abstract",
            "CASE WHEN doc_id % 2 = 0 THEN cast(1990 + doc_id % 35 AS string) END AS year",
            "CASE WHEN doc_id % 5 = 1 THEN 'Spring' "
            "WHEN doc_id % 2 = 1 THEN concat(1990 + doc_id % 35, ' Dec') END AS medline_date",
            "array(named_struct('fore_name', lang, 'last_name', source), "
            "named_struct('fore_name', cast(NULL AS string), 'last_name', source)) AS authors",
            "lang",
        )
    )


def write_xml(fields: DataFrame, path: str, compression: str = "none", by: str | None = None) -> None:
    """Add raw fields to a folder of XML files where they are. Every third title ends with an inline element."""
    citation = """named_struct(
        'PMID', pmid,
        'Article', named_struct(
            'Journal', named_struct('JournalIssue', named_struct(
                'PubDate', named_struct('Year', year, 'MedlineDate', medline_date))),
            'ArticleTitle', named_struct('_VALUE', title, 'i', if(try_cast(pmid AS bigint) % 3 = 0, 'in vitro', NULL)),
            'Abstract', named_struct('AbstractText', if(abstract IS NULL, NULL,
                array(abstract, concat('second section of ', pmid)))),
            'AuthorList', named_struct('Author', transform(authors, a ->
                named_struct('LastName', a.last_name, 'ForeName', a.fore_name)))
        )) AS MedlineCitation"""
    rows = fields.selectExpr(citation, *([by] if by else []))
    writer = rows.write.format("xml").mode("append").option("compression", compression)
    writer = writer.option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet")
    (writer.partitionBy(by) if by else writer).save(path)


# Token vectors: eight consecutive vectors are the tokens of one document.
TOKENS_SQL = """t AS (
    SELECT vec_id // 8 AS doc_id, vec_id % 8 AS pos, CASE WHEN label < 7 THEN 1 ELSE 0 END AS mask,
           embedding AS vec
    FROM embeddings)"""


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).selectExpr(
        "doc_id div 8 AS doc_id", "doc_id % 8 AS pos", "if(label < 7, 1, 0) AS mask",
        "doc_vector AS vec",
    )


def long_form(table: DataFrame, value: str = "round(cast(value AS double), 6)") -> DataFrame:
    """One row per vector element; a NULL vector gives one row without element."""
    return table.selectExpr("doc_id", "posexplode_outer(doc_vector) AS (dim, value)").selectExpr(
        "doc_id", "dim", f"{value} AS value"
    )
