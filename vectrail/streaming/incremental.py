"""Incremental ingest: every new XML file once, first copy of each article wins."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.operators.dedup import insert_or_ignore
from vectrail.operators.lookup import LISTED_IDS, one_of
from vectrail.schema import ARTICLE_COLUMNS, ARTICLES, DOC_ID, SOURCE_ORDER
from vectrail.scratch import folder_bytes, remove_folder
from vectrail.sources.article_xml import (
    FILE_PATTERN,
    parse_records,
    positioned,
    record_columns,
    record_options,
)
from vectrail.sources.tables import write_articles

_LEDGER, _BATCH = "ledger", "batch_id"
_STORED = T.StructType(
    [
        *ARTICLES.fields,
        T.StructField(_LEDGER, T.StringType()),
        T.StructField(_BATCH, T.LongType()),
    ]
)
# Files of one micro-batch unless the caller says otherwise, so that a first run over a large
# folder is cut into pieces that can be repeated.
MAX_FILES_PER_BATCH = 1_000
# The ledger of merged batches; their batch_id is the number of the merge.
_MERGED = "merged"
_GENERATIONS = "_generations"
_GENERATION = T.StructType(
    [
        T.StructField(_LEDGER, T.StringType()),
        T.StructField(_BATCH, T.LongType()),
        T.StructField("generation", T.LongType()),
    ]
)
# Rows of one file of a merged table, and bytes as they were stored before.
MERGED_RECORDS_PER_FILE = 1_000_000
MERGED_BYTES_PER_FILE = 64 << 20
# A merge cuts the ids at so many sampled rows per file, writes so many files per core in one job, and reads
# each range from the stored files as long as it opens no more than so many files in all.
SAMPLED_PER_FILE, FILES_PER_CORE, OPENED_FILES = 100, 2, 1 << 18
# The number of a row in its batch, and words of marks that are sent to all tasks at most (of 64 rows
# each, so 67 million rows).
_ROW, _WORD = SOURCE_ORDER[-1], "word"
SENT_WORDS = 1 << 20
# The rows to add are packed into full files if they are fewer than this share of their batch.
PACKED_SHARE = 0.25
# Ids of a batch lie in so many ranges at most, and are first counted in so many cells.
ID_RANGES, ID_CELLS = 16, 4096
# Settings of Spark: whether shuffled files go when a query ends, whether parts of one task each stay one
# task when they are united, and how many parts files are cut into.
_DELETE_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ONE_TASK = "spark.sql.unionOutputPartitioning"
_PARTS, _CORES = "spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism"


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """The article table that :func:`ingest_new_files` maintains."""
    return _stored(spark, table).select(*ARTICLE_COLUMNS)


def _read(reader: Callable[[str], DataFrame], path: str) -> DataFrame | None:
    try:
        return reader(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _last_merge(spark: SparkSession, table: str) -> tuple[int, dict[str, int]]:
    """The number of the last committed merge, and of each ledger the last batch that is in it."""
    found = _read(spark.read.schema(_GENERATION).json, f"{table}/{_GENERATIONS}")
    rows = [] if found is None else found.collect()  # a row per ledger and merge
    last = max((r["generation"] for r in rows), default=0)
    return last, {r[_LEDGER]: r[_BATCH] for r in rows if r["generation"] == last}


def _folder(table: str, ledger: str, batch: int) -> str:
    return f"{table}/{_LEDGER}={ledger}/{_BATCH}={batch}"


def _files(spark: SparkSession, table: str) -> DataFrame:
    """All rows below the table, those of replaced or unfinished folders included."""
    found = _read(spark.read.schema(_STORED).parquet, table)
    return spark.createDataFrame([], _STORED) if found is None else found


def _visible(spark: SparkSession, table: str) -> Column:
    """Which folders are the table: the last merge, and of each ledger the batches after it."""
    last, merged = _last_merge(spark, table)
    later = [(F.col(_LEDGER) != name) | (F.col(_BATCH) > batch) for name, batch in merged.items()]
    batches = reduce(and_, later, F.col(_LEDGER) != _MERGED)
    return batches | ((F.col(_LEDGER) == _MERGED) & (F.col(_BATCH) == last))


def _stored(spark: SparkSession, table: str) -> DataFrame:
    return _files(spark, table).where(_visible(spark, table))


def id_filter(ids: DataFrame, key: str = DOC_ID) -> Column:
    """A condition on ``key`` that holds for all of ``ids``, and that the files of a table can answer.

    Few ids are named, so that bloom filters and pages are asked for each. More are covered by at
    most ``ID_RANGES`` ranges, cut at the widest gaps between occupied cells of their span; statistics
    of row groups outside these ranges leave them unread. NULL ids are asked for if there are any.
    ``ids`` is read up to three times.
    """
    low, high, n, known = ids.agg(F.min(key), F.max(key), F.count("*"), F.count(key)).first()
    few = [] if low is None else ids.select(key).distinct().limit(LISTED_IDS + 1).collect()
    if len(few) <= LISTED_IDS:
        found = one_of(key, (r[0] for r in few if r[0] is not None))
    else:
        width = (high - low) // ID_CELLS + 1
        # The difference of two longs may not fit in one.
        cell = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).alias("cell")
        cells = ids.where(F.col(key).isNotNull()).groupBy(cell)
        cells = cells.agg(F.min(key).alias("first"), F.max(key).alias("last"))
        spans = sorted((r["first"], r["last"]) for r in cells.collect())  # ID_CELLS rows and one more
        gaps = sorted(range(1, len(spans)), key=lambda i: spans[i - 1][1] - spans[i][0])
        cuts = [0, *sorted(gaps[: ID_RANGES - 1]), len(spans)]
        ranges = [F.col(key).between(spans[a][0], spans[b - 1][1]) for a, b in zip(cuts, cuts[1:])]
        found = reduce(or_, ranges)
    return found if known == n else found | F.col(key).isNull()


def _from(column: str, value: int | str) -> Column:
    if column == DOC_ID:
        return F.col(DOC_ID) >= value
    return F.col(DOC_ID).isNotNull() | (F.col("pmid") >= value)


def _below(column: str, value: int | str) -> Column:
    if column == DOC_ID:
        return F.col(DOC_ID).isNull() | (F.col(DOC_ID) < value)
    return F.col(DOC_ID).isNull() & (F.col("pmid").isNull() | (F.col("pmid") < value))


def _id_ranges(stored: DataFrame, rows: int, n: int) -> list[Column]:
    """Conditions of about ``n`` ranges of ids of like numbers of rows; each row meets exactly one.

    Rows without a numeric id come first, by ``pmid``; others are cut between numbers only. The cuts are
    those of a sample of ``SAMPLED_PER_FILE`` rows a range.
    """
    if n == 1:
        return [F.lit(True)]
    ids = stored.select(DOC_ID, "pmid").sample(min(1.0, n * SAMPLED_PER_FILE / rows), seed=0)
    found = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in ids.collect())
    cuts = (found[i * len(found) // n] for i in range(1, n) if found)
    cuts = list(dict.fromkeys((DOC_ID, i) if numeric else ("pmid", p) for numeric, i, p in cuts))
    starts, ends = [F.lit(True), *(_from(*c) for c in cuts)], [*(_below(*c) for c in cuts), F.lit(True)]
    return [start & end for start, end in zip(starts, ends)]


@contextmanager
def _setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _write_in_order(stored: DataFrame, rows: int, n_files: int, n_stored: int, folder: str) -> None:
    """Write the rows as ``n_files`` ranges of ids, in jobs of a few files per core.

    A task reads the pages of its range out of stored files that are each in id order, so nothing is
    shuffled. Where files are so many that opening each for each range is too much, a job reads its ranges
    at once and shuffles their rows, and Spark deletes what it shuffled when the job ends.
    """
    spark = stored.sparkSession
    ranges = _id_ranges(stored, rows, n_files)
    step = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    for first in range(0, len(ranges), step):
        some = ranges[first : first + step]
        if n_files * n_stored <= OPENED_FILES:
            part = reduce(DataFrame.unionAll, (stored.where(r).coalesce(1) for r in some))
        else:
            part = stored.where(reduce(or_, some)).repartitionByRange(len(some), DOC_ID, "pmid")
        with _setting(spark, _DELETE_SHUFFLED, "true"), _setting(spark, _ONE_TASK, "false"):
            write_articles(part, folder, mode="append" if first else "overwrite")


def merge_batches(
    spark: SparkSession,
    table: str,
    records_per_file: int = MERGED_RECORDS_PER_FILE,
    bytes_per_file: int = MERGED_BYTES_PER_FILE,
) -> int:
    """Write the batches of the table, and what was merged before, as large files in id order.

    Returns the number of folders that it replaced; fewer than two are left as they are. Rows are
    split by ranges of ids, so that the ids of a batch meet few files; rows without a numeric id are
    ordered by ``pmid``. There are as many ranges as rows or bytes ask for, whichever is more, so
    neither many rows nor long ones make a large task. Beside the old and the new files a merge needs no
    disk, or that of the rows of one job (see :func:`_write_in_order`). One small file commits the merge: until it is there readers see the old
    folders, and from then on the new one alone, so a merge that is stopped loses and repeats
    nothing, and the next one deletes what it left. A batch that is repeated after a merge finds its
    rows stored. Must not run beside an ingest into the same table, nor beside its readers, whose files
    it deletes.
    """
    last, _ = _last_merge(spark, table)
    files = _files(spark, table)
    folders = files.groupBy(_LEDGER, _BATCH).count().collect()  # a row per batch since the last merge
    batches = [(r[_LEDGER], r[_BATCH]) for r in folders if r[_LEDGER] != _MERGED]
    stored = _stored(spark, table)
    replaced = [r for r in stored.groupBy(_LEDGER, _BATCH).count().collect()]
    if len(replaced) >= 2:
        rows = sum(r["count"] for r in replaced)
        size = sum(folder_bytes(spark, _folder(table, r[_LEDGER], r[_BATCH])) for r in replaced)
        n_files = max(-(-rows // records_per_file), -(-size // bytes_per_file))
        number = max([last, *(r[_BATCH] for r in folders if r[_LEDGER] == _MERGED)]) + 1
        n_stored = len(stored.inputFiles())
        _write_in_order(stored, rows, n_files, n_stored, _folder(table, _MERGED, number))
        ends = {name: max(b for n, b in batches if n == name) for name, _ in batches}
        commit = spark.createDataFrame(list(ends.items()), _GENERATION.fieldNames()[:2]).coalesce(1)
        commit.write.mode("overwrite").json(f"{table}/{_GENERATIONS}/generation={number}")
    # Folders that readers do not see any more, of this merge and of stopped ones.
    last, merged = _last_merge(spark, table)
    for name, batch in {(r[_LEDGER], r[_BATCH]) for r in folders}:
        if batch != last if name == _MERGED else batch <= merged.get(name, -1):
            remove_folder(spark, _folder(table, name, batch))
    return len(replaced) if len(replaced) >= 2 else 0


@contextmanager
def _persisted(df: DataFrame) -> Iterator[DataFrame]:
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _marks(positions: DataFrame) -> DataFrame:
    """The rows of a batch at these positions, as a bit for each row in words of 64 rows."""
    word = F.expr(f"{_ROW} div 64").alias(_WORD)
    bits = F.expr(f"bit_or(shiftleft(1L, cast({_ROW} % 64 AS int)))").alias("bits")
    return positions.groupBy(word).agg(bits, _digest().alias("digest"))


def _digest() -> Column:
    """A number that stands for a set of ids."""
    return F.bit_xor(F.xxhash64("pmid"))


def _rows_at(records: DataFrame, marks: DataFrame, n_words: int) -> DataFrame:
    """The marked rows where they are; only of very many words are the records shuffled."""
    marks = marks.select(_WORD, "bits")
    marks = F.broadcast(marks) if n_words <= SENT_WORDS else marks
    marked = records.withColumn(_WORD, F.expr(f"{_ROW} div 64")).join(marks, _WORD)
    return marked.where(F.expr(f"getbit(bits, cast({_ROW} % 64 AS int)) = 1")).drop(_WORD, "bits")


def _ledger_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint from its first run on."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").head()[0]


def ingest_new_files(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    *,
    pattern: str = FILE_PATTERN,
    max_files_per_batch: int = MAX_FILES_PER_BATCH,
    rebalance: bool = False,
    clean_source: str = "off",
    archive: str | None = None,
) -> None:
    """Append the articles of all files not seen before to ``table``, then stop.

    The stream's checkpoint is the ledger of files, and one table may have several. Each
    micro-batch keeps the first copy of every id by file name and place in the file, drops ids that
    are stored already, whichever ledger brought them, and overwrites a folder named after its
    ledger and its number, so that a batch repeated after a failure replaces what it left behind
    and nothing else. Ids are compared with the stored rows that :func:`id_filter` leaves, so a batch of
    neighbouring or few ids reads little of a large table, least after :func:`merge_batches`. Only ids
    and places of the rows are kept and shuffled to find those to add; then the files are read again, and
    records to add are parsed and written where they are, or packed into full files if they are few. So no
    text waits on disk. A batch whose files changed in between fails, and is repeated by the next run.
    Ledgers of one table must not run at the same time. ``clean_source`` is ``off``, ``archive`` (with a folder) or
    ``delete``, and is applied to files whose batch is committed.
    """
    options = {**record_options(pattern), "cleanSource": clean_source}
    if archive:
        options["sourceArchiveDir"] = archive
    options["maxFilesPerTrigger"] = str(max_files_per_batch)
    lines = spark.readStream.options(**options).text(source).select(*record_columns())

    def parsed(records: DataFrame) -> DataFrame:
        return parse_records(records.hint("rebalance") if rebalance else records)

    def store(batch: DataFrame, batch_id: int) -> None:
        session, records = batch.sparkSession, positioned(batch)
        ledger = _ledger_id(session, checkpoint)
        own = (F.col(_LEDGER) == ledger) & (F.col(_BATCH) == batch_id)
        with _persisted(parsed(records).select("pmid", DOC_ID, *SOURCE_ORDER)) as places:
            # Rows of equal pmid have equal ids, so rows outside the filter cannot be known ones.
            others = _stored(session, table).where(~own).where(id_filter(places))
            new = insert_or_ignore(others, places.drop(DOC_ID), "pmid", SOURCE_ORDER)
            with _persisted(_marks(new)) as marks:
                n_words, *wanted = marks.agg(
                    F.count("*"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)), F.bit_xor("digest")
                ).first()
                added = parsed(_rows_at(records, marks, n_words))
                few = wanted[0] < PACKED_SHARE * places.count()
                folder = _folder(table, ledger, batch_id)
                write_articles(added.hint("rebalance") if few else added, folder, mode="overwrite")
        stored = session.read.schema(ARTICLES).parquet(folder)
        if [*stored.agg(F.count("*"), _digest()).first()] != wanted:
            raise RuntimeError(f"the files of batch {batch_id} of {source} changed while they were read")

    # Both times a batch's files are cut alike, also if executors come or go in between.
    parts = spark.conf.get(_PARTS, None) or spark.conf.get(_CORES, None) or spark.sparkContext.defaultParallelism
    with _setting(spark, _PARTS, parts):
        stream = (
            lines.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
