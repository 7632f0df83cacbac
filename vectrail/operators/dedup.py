"""First-wins deduplication of keyed records."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the earliest row of each key by ``order``.

    Spark limits each map task to its own first row per key before the shuffle, so even a key with
    most of the rows sends at most one row per task.
    """
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("first_wins_position", position).where("first_wins_position = 1").drop(
        "first_wins_position"
    )


def insert_or_ignore(
    existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]
) -> DataFrame:
    """The incoming rows to append: the first of each key that ``existing`` does not have yet.

    Stored keys are first reduced to those that come in again, so that a small batch meets a large
    table in one scan of its keys. ``incoming`` is read twice; persist it if that is costly.
    """
    known = existing.select(key).join(incoming.select(key), key, "left_semi")
    return first_wins(incoming, key, order).join(known, key, "left_anti")


def upsert_ignore(
    existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]
) -> DataFrame:
    """``existing`` with the new keys of ``incoming`` added; rows already there never change."""
    added = insert_or_ignore(existing, incoming, key, order).select(*existing.columns)
    return existing.unionByName(added)
