"""Fetching rows by id, and joining articles to search hits."""

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.schema import DOC_ID, DOCUMENT_COLUMNS
from vectrail.scratch import written

_IDS = T.StructType([T.StructField(DOC_ID, T.LongType())])

#: At most so many ids become a filter; more are joined.
LISTED_IDS = 1000
# Parquet compares ids one by one with statistics and bloom filters in lists of up to so many; of a
# longer list it only sees the range.
_PUSHED = 10


def one_of(key: str, ids: Iterable[int]) -> Column:
    """Whether a key is one of a few ids, in a form that reaches the files whole."""
    ids = sorted(set(ids))
    lists = [F.col(key).isin(ids[i : i + _PUSHED]) for i in range(0, len(ids), _PUSHED)]
    return reduce(or_, lists) if lists else F.lit(False)


def rows_by_id(table: DataFrame, ids: DataFrame, nulls: bool = False) -> DataFrame:
    """The rows of a table whose id is in ``ids``, which may be of any size and repeat.

    Of at most ``LISTED_IDS`` different ids the list is read first, and the files of the table are
    asked for these ids alone. More ids are a semi join. A NULL id has no row, or with ``nulls`` all
    rows without an id. ``ids`` is read twice, so a search should be stored first.
    """
    wanted = ids.select(DOC_ID)
    few = [r[0] for r in wanted.distinct().limit(LISTED_IDS + 1).collect()]
    if len(few) <= LISTED_IDS:
        found = one_of(DOC_ID, (i for i in few if i is not None))
        return table.where(found | F.col(DOC_ID).isNull() if nulls and None in few else found)
    named = wanted.withColumnRenamed(DOC_ID, "wanted")
    same = F.col(DOC_ID).eqNullSafe(F.col("wanted")) if nulls else F.col(DOC_ID) == F.col("wanted")
    return table.join(named, same, "left_semi")


def lookup_ids(articles: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The articles of a list of ids, in no particular order; unknown ids are left out."""
    ids = {int(i) for i in ids}
    if len(ids) > LISTED_IDS:
        rows = articles.sparkSession.createDataFrame([(i,) for i in ids], _IDS)
        # The driver's list bounds the frame, whose size Spark does not know.
        return articles.select(DOC_ID, *DOCUMENT_COLUMNS).join(F.broadcast(rows), DOC_ID, "left_semi")
    return articles.select(DOC_ID, *DOCUMENT_COLUMNS).where(one_of(DOC_ID, ids))


def lookup(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """The articles whose id is in ``ids``: few are read from the files by id, many are joined."""
    return rows_by_id(articles.select(DOC_ID, *DOCUMENT_COLUMNS), ids)


def attach_documents(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Add the article columns to each hit by id; a hit without an article keeps NULLs.

    A score always stands beside the article it belongs to, whatever the order of either side. The
    hits are written once, so the search runs once. Few hits are a filter on the files of the
    articles; of many, only the articles hit take part in the join.
    """
    hits = written(hits, "hits")
    return hits.join(lookup(articles, hits), DOC_ID, "left")
