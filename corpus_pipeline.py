"""The corpus pipeline: stages over documents, each with one operator of vectrail.llm.

Every stage but the last returns the columns of the documents it was given. Rows are told apart by a
hash of id and text, and equal rows by their number, so repeated ids and rows do not multiply.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.deploy import ship
from vectrail.llm import best_fit, cube_mix, jaccard_join, lang_cnn, suffix_dedup
from vectrail.llm.queries import tokenizer_path
from vectrail.llm.registry import table
from vectrail.scratch import new_path, remove_scratch, scratch_mark, written

#: All stages share the Python workers, so each takes little memory: words that packing keeps there,
#: and rows of an Arrow batch, which hold whole texts.
CACHED_WORDS, BATCH_ROWS = 100_000, 1000
#: Near copies share this percentage of their shingles of so many words; op4's own query is stricter.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def _ready(spark: SparkSession) -> None:
    """Send the package to the executors and keep Arrow batches small."""
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def _row_name(text: Column) -> Column:
    """What suffix_dedup calls text_hash."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")).cast("binary"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters go, and no others, even if no
    document is labelled."""
    _ready(spark)
    whole = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("row"))
    found = lang_cnn.predict_languages(whole)
    return found.where(~F.col("lang_pred").eqNullSafe(lang_cnn.UNDETERMINED)).select("row.*")


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, with its smallest doc_id, and rows without an id."""
    _ready(spark)
    # Rows with equal ids and other texts are documents of their own, so classes are made of row names.
    named = docs.select(
        _row_name(F.col("text")).alias("name"), "doc_id", "text", F.struct(*docs.columns).alias("row")
    )
    keyed = named.where("doc_id is not null")
    classes = jaccard_join.similarity_classes(
        keyed.select(F.col("name").alias("doc_id"), "text"), width=SHINGLE_WORDS, percent=NEAR_PERCENT
    )
    linked = classes.select(F.col("doc_id").alias("name"), F.col("component_id").alias("class")).distinct()
    members = written(linked.join(keyed.select("name", "doc_id").distinct(), "name"), "members")
    least = members.groupBy("class").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "name")).alias("least"))
    heads = written(least.where("n > 1").select("class", F.col("least.name").alias("head")), "heads")
    copies = members.join(heads, "class").where("name <> head").select("name")
    left = named.join(copies, "name", "left_anti")
    # Rows that are there more than once are few; of equal ones one stays.
    again = left.where("doc_id is not null").groupBy("name").count().where("count > 1").select("name")
    once = left.join(again, "name", "left_anti").select("row.*")
    several = left.join(again, "name", "left_semi").dropDuplicates(["doc_id", "text"]).select("row.*")
    return once.unionByName(several)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what documents with smaller ids hold too; n_chars, if there, is counted anew."""
    _ready(spark)
    left = suffix_dedup.remove_repeats(docs).select("text_hash", "kept")
    # The other columns travel as one, so that their names cannot clash with those used here.
    rest = docs.select(
        _row_name(F.col("text")).alias("text_hash"),
        F.struct(*(c for c in docs.columns if c != "text")).alias("row"),
    )
    joined = rest.join(left.dropDuplicates(["text_hash"]), "text_hash")
    texts = joined.select("row", suffix_dedup.whole_characters(F.col("kept")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return texts.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    _ready(spark)
    named = docs.select(_row_name(F.col("text")).alias("name"), F.struct(*docs.columns).alias("row"))
    mixed = cube_mix.mix(named.select(F.col("name").alias("doc_id"), "row.source", "row.text"))
    taken = mixed.select(F.col("doc_id").alias("name"), "copies")
    number = F.row_number()
    taken = taken.withColumn("nth", number.over(Window.partitionBy("name").orderBy("copies")))
    rows = named.withColumn("nth", number.over(Window.partitionBy("name").orderBy(F.lit(0))))
    joined = rows.join(taken.where("copies > 0"), ["name", "nth"])
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences of 4096 tokens."""
    _ready(spark)
    return best_fit.pack_documents(docs, tokenizer_path(), cached=CACHED_WORDS)


STAGES = [
    ("keep_known_languages", keep_known_languages),
    ("keep_one_of_each_class", keep_one_of_each_class),
    ("remove_repeated_passages", remove_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_best_fit", pack_best_fit),
]

#: Training, suffix sorting, balanced sampling and tokenizing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read by the next one.

    What a stage wrote on its way is deleted once its result is there.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, before = new_path(spark, name), scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_scratch(spark, since=before)
        docs = spark.read.parquet(path)
    return docs
