"""Connected components of links between rows, by alternating large and small stars.

Each round hangs every node on the smallest node that it knows, first its larger neighbours, then
its smaller ones, until only stars are left. A round is two aggregations with partial sums and two
joins, which Spark splits where a node has very many links; nothing comes to the driver but two
numbers a round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.scratch import written


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("least"))


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def stars(edges: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of longs, in any order, to ``(node, component_id)`` of every node but those
    that are the smallest of their component. Links from a node to itself are ignored."""
    larger = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(larger.where("a > b").distinct(), "links")
    state = _state(now)
    while True:
        # Large star: the larger neighbours of each node hang on the least of all its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "least").alias("least"))
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(hung.distinct(), "links")
        # Small star: the smaller neighbours of each node, and itself, hang on the least of them.
        joined = large.join(_least(large), "a")
        moved = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = written(moved.unionByName(_least(large).withColumnRenamed("least", "b")).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
