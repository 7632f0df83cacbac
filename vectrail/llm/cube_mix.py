"""Mixing sources to target weights by the cube method.

A source that shall give r times its size takes every document floor(r) times, and once more with
probability r - floor(r). Which ones is chosen by balanced sampling: fractional probabilities move
along directions that change neither the expected words nor the expected documents, until they are
0 or 1. Blocks of one source move on their own; what stays fractional, at most two documents a block,
moves on in larger blocks, until one block a source is left. Its last two documents are settled to
be nearest to the target.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.scratch import written

#: White space in ASCII separates words (fixed by the contract of the query).
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 4096
#: Equal rows that are numbered at once.
EQUALS = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0, share: float = 1.0
) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from rows ``(source, size)``.

    Sources in code-point order, null last, take the weights in turn and share ``share`` of all
    words. A target above ``most`` times its source's size stops there and the excess is shared
    anew by weight. Sources ordered by size over weight reach their bounds in that order, so one
    running sum finds where the bounds end. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (F.col("all_words") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    levelled = (
        totals.withColumn("weight", weight)
        .withColumn("bound", bound)
        .withColumn("all_words", all_words)
        .withColumn("level", level)
    )
    # The first source below its bound fixes the level for itself and all that follow.
    free = F.when(F.col("level") * F.col("weight") < F.col("bound"), F.col("level"))
    final = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return levelled.withColumn("final", final).select(
        "source",
        "source_size",
        "n_docs",
        F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("bound")), F.col("bound")).alias("target"),
    )


def flight(sizes: np.ndarray, chance: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Move ``chance`` until at most two units are fractional, keeping the sums of ``chance`` and
    of ``chance * sizes``.

    Three fractional units always leave one direction that keeps both sums: the cross product of
    the two rows of constraints. The step along it or against it is drawn so that no expected
    value changes. Units enter from the largest to the smallest, so that small ones are left.
    """
    chance = chance.astype(float)
    draws = random.random(len(sizes))
    held: list[int] = []
    for unit in np.argsort(-sizes, kind="stable").tolist():
        if not 0.0 < chance[unit] < 1.0:
            continue
        held.append(unit)
        if len(held) < 3:
            continue
        a, b, c = (float(sizes[u]) for u in held)
        way = (b - c, c - a, a - b)
        if way == (0.0, 0.0, 0.0):
            way = (1.0, -1.0, 0.0)
        p = [float(chance[u]) for u in held]
        up = min((1.0 - x) / d if d > 0 else x / -d for x, d in zip(p, way) if d)
        down = min(x / d if d > 0 else (1.0 - x) / -d for x, d in zip(p, way) if d)
        step = up if draws[unit] * (up + down) < down else -down
        for u, x, d in zip(held, p, way):
            moved = x + step * d
            chance[u] = 0.0 if moved < 1e-9 else 1.0 if moved > 1 - 1e-9 else moved
        held = [u for u in held if 0.0 < chance[u] < 1.0]
    return chance


def land(sizes: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Settle the few fractional units by the rounding nearest to the expected words, then to the
    expected documents."""
    loose = np.flatnonzero((chance > 0.0) & (chance < 1.0))
    if len(loose) == 0:
        return chance
    ways = np.array(np.meshgrid(*[[0.0, 1.0]] * len(loose))).reshape(len(loose), -1).T
    words = np.abs(ways @ sizes[loose] - chance[loose] @ sizes[loose])
    count = np.abs(ways.sum(axis=1) - chance[loose].sum())
    out = chance.copy()
    out[loose] = ways[np.lexsort((count, words))[0]]
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """The same rows with the number ``nth`` of each among its equals.

    Equal rows stand for each other, so they are counted in the map tasks and written out again, in
    stretches that are dealt to all tasks: no task sees all rows of an id.
    """
    counted = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "counted")
    begin = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(EQUALS))).alias("begin")
    stretches = counted.select(*rows.columns, "n", begin)
    few = stretches.where(F.col("n") <= EQUALS)
    many = stretches.where(F.col("n") > EQUALS).repartition(*rows.columns, "begin")
    end = F.least("n", F.col("begin") + EQUALS) - 1
    return few.unionByName(many).select(*rows.columns, F.explode(F.sequence("begin", end)).alias("nth"))


def _fly(rows: DataFrame, level: int, blocks: Column, last: bool, seed: int) -> DataFrame:
    """One level: each block of a source moves on its own."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "no_id", "nth", "chance"], kind="stable")
        sizes = rows["size"].to_numpy()
        key = [seed, level, int(rows["block"].iloc[0]), len(rows), int(sizes.sum())]
        chance = flight(sizes, rows["chance"].to_numpy(), np.random.default_rng(key))
        return rows.assign(chance=land(sizes, chance) if last else chance)

    block = F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(seed + level)), blocks).cast("long")
    dealt = rows.withColumn("block", block)
    return dealt.groupBy("source", "block").applyInPandas(one, dealt.schema).drop("block")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: float = 3.0,
    share: float = 1.0,
    seed: int = 10,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)``, one row per row of ``docs``: its words,
    its source's words and target, how often the mix takes it and ``taken = copies * size``.

    Null texts have size 0, a null source is a source of its own, repeated rows are documents of
    their own, and other columns are ignored. An empty table gives an empty one. Texts do not
    leave the scan. A source is dealt to as many blocks as its documents need, by id, size and number
    among equal rows, so neither a source nor an id is gathered in one task. The same rows give the same mix, however they are partitioned. A document without words
    can be taken without effect and stays out of the balancing.
    """
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # pandas would make fractions of whole numbers beside nulls.
    no_id = F.col("doc_id").isNull()
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        no_id.alias("no_id"),
        "source",
        word_count(F.col("text")).alias("size"),
    )
    sizes = _numbered(named)
    targets = written(source_targets(sizes, weights, most, share), "targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    # One row per source and share of its documents, so that a large source meets many tasks.
    dealt = targets.withColumnRenamed("source", "of").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    )
    part = F.pmod(F.xxhash64("doc_id", "size", "nth"), F.lit(spread)).cast("int")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    found = (
        sizes.withColumn("here", part)
        .join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("here") == F.col("part")))
        .withColumn("copies", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("int"))
        .withColumn("chance", F.when(F.col("size") > 0, rate - F.col("copies")).otherwise(0.0))
        .select("doc_id", "no_id", "nth", "source", "size", "source_size", "n_docs", "target", "copies", "chance")
    )
    settled: list[DataFrame] = []
    level, blocks = 0, -(-largest // block)
    loose, at = found, F.ceil(F.col("n_docs") / block)
    while True:
        last = blocks <= 1
        moved = _fly(loose, level, F.greatest(at, F.lit(1)).cast("long"), last, seed)
        if last:
            settled.append(moved)
            break
        moved = written(moved, f"mix-{level}")
        fractional = (F.col("chance") > 0.0) & (F.col("chance") < 1.0)
        settled.append(moved.where(~fractional))
        loose = moved.where(fractional)
        level, blocks, at = level + 1, -(-2 * blocks // block), F.ceil(2 * at / block)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.col("copies") + F.round("chance").cast("int")
    return out.withColumn("copies", copies).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
