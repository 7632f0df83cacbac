"""What each of five filters removes in every order, from truth-table survival words.

A document's failures are five bits. Its survival word has a bit for each of the 32 subsets of the
filters, set where the document passes all filters of the subset. The words of a part and label are
counted bit by bit with carry-save adders, and every figure of all 120 orders follows from these 32
counts: after the filters of a subset, whatever their order, its count of documents is left.
"""

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Fixed values of the filters: fewest words, least percentage of distinct words, most percentage of
#: capitals, and the characters that a text must not hold.
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"

_KEYS = ["part", "quality", "toxic"]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, A lowest; all but E need the text alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("long")
    return F.transform(
        F.array(words),
        lambda w: (F.size(w) < FEWEST_WORDS).cast("int")
        + F.when(F.size(F.array_distinct(w)).cast("long") * 100 < F.size(w).cast("long") * DISTINCT_PERCENT, 2).otherwise(0)
        + F.when(capitals * 100 > F.length(text) * CAPITAL_PERCENT, 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0),
    )[0]


def survival_word(failures: Column) -> Column:
    """The word of a mask of failures: bit S is set if no filter of the subset S fails."""
    word = F.lit((1 << SUBSETS) - 1)
    for f in range(len(FILTERS)):
        without = sum(1 << s for s in range(SUBSETS) if not s >> f & 1)
        word = word.bitwiseAND(F.when(failures.bitwiseAND(1 << f) != 0, F.lit(without)).otherwise(F.lit(-1)))
    return word


def positional_popcount(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many words have each bit set, of 32-bit words that are there so many times.

    A word enters at the weights whose sum is its number. Three words of one weight become a sum of
    that weight and a carry of twice the weight, for all bits at once, until at most two words of each
    weight are left.
    """
    counts = np.zeros(SUBSETS, dtype=np.int64)
    bits = np.arange(SUBSETS, dtype=np.uint32)
    words, times = words.astype(np.uint32), times.astype(np.int64)
    carried, shift = words[:0], 0
    while len(carried) or (times >> shift).any():
        level = np.concatenate([carried, words[(times >> shift) & 1 == 1]])
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, level[3 * third :]])
        counts += ((level[:, None] >> bits) & 1).sum(axis=0).astype(np.int64) << shift
        carried, shift = np.concatenate([words[:0], *carries]), shift + 1
    return counts


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for (part, quality, toxic), group in rows.groupby(_KEYS, sort=False):
            counts = positional_popcount(group["word"].to_numpy(), group["docs"].to_numpy())
            yield pd.DataFrame({"part": part, "quality": quality, "toxic": toxic, "counts": [counts]})


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(part, quality, toxic, failures, docs)``: documents of one text with these failed filters,
    all five; a text has two rows at most for each part and label.

    A null text is empty and a null language the part ''. A document fails E if a row with a smaller
    doc_id holds the same text (by its 128-bit digest); a null doc_id is neither smaller nor larger.
    ``quality`` and ``toxic`` are 1 where any label row of the doc_id says 1. Only digests are
    shuffled, and copies of a text are added in every task before they meet.
    """
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        text_failures(text).alias("failures"),
    ).join(said, "doc_id", "left")
    rows = rows.fillna(0, ["quality", "toxic"])
    # All rows of a text fail the same of the other filters; those of its least doc_id pass E.
    keys = ["digest", "failures", *_KEYS]
    by_id = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unnamed"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    pass_e = F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    both = groups.withColumn("pass_e", pass_e).select(
        *_KEYS,
        F.explode(
            F.array(
                F.struct("failures", F.col("pass_e").alias("docs")),
                F.struct((F.col("failures") + 16).alias("failures"), (F.col("n") - F.col("pass_e")).alias("docs")),
            )
        ).alias("one"),
    )
    return both.select(*_KEYS, "one.*").where("docs > 0")


def subset_survivors(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(part, quality, toxic, counts)``: survivors of each of the 32 subsets of the filters.

    Words of equal part and label are counted in every task before they meet.
    """
    failed = failure_counts(documents, labels)
    words = failed.select(*_KEYS, "docs", survival_word(F.col("failures")).alias("word"))
    counted = words.mapInPandas(_count_words, "part string, quality int, toxic int, counts array<long>")
    sums = [F.sum(F.col("counts")[s]).alias(f"c{s}") for s in range(SUBSETS)]
    return counted.groupBy(*_KEYS).agg(*sums).select(
        *_KEYS, F.array(*(f"c{s}" for s in range(SUBSETS))).alias("counts")
    )


def interaction_report(survivors: DataFrame) -> DataFrame:
    """The figures of every part, order and step from the counts of :func:`subset_survivors`."""
    full = SUBSETS - 1

    def total(condition: Column) -> Column:
        one = [F.sum(F.when(condition, F.col("counts")[s]).otherwise(0)) for s in range(SUBSETS)]
        return F.array(*one)

    parts = survivors.groupBy("part").agg(
        total(F.lit(True)).alias("left"),
        total(F.col("quality") == 1).alias("good"),
        total(F.col("toxic") == 1).alias("bad"),
    )

    def shapley(f: int) -> Column:
        # A filter comes after exactly the filters of s in |s|! (4 - |s|)! of all orders.
        terms = []
        for s in range(SUBSETS):
            if not s >> f & 1:
                n = s.bit_count()
                ways = factorial(n) * factorial(len(FILTERS) - 1 - n)
                terms.append(ways * (F.col("left")[s] - F.col("left")[s | 1 << f]))
        return sum(terms[1:], terms[0])

    # Fixed values, the same for every part: what stands before and after each step of each order.
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            f = FILTERS.index(letter)
            steps.append(("".join(order), step, f, before, before | 1 << f))
            before |= 1 << f
    # The list has 600 entries whatever the data, so each part's row is repeated that often.
    listed = ",".join(f"{o} {s} {f} {b} {a}" for o, s, f, b, a in steps)
    field = F.split("entry", " ")
    rows = parts.withColumn("shares", F.array(*(shapley(f) for f in range(len(FILTERS))))).select(
        "part", "left", "good", "bad", "shares", F.explode(F.split(F.lit(listed), ",")).alias("entry")
    )
    rows = rows.select(
        "*",
        field[0].alias("filter_order"),
        field[1].cast("int").alias("step"),
        field[2].cast("int").alias("f"),
        field[3].cast("int").alias("before"),
        field[4].cast("int").alias("after"),
    )
    at = lambda column, index: F.get(F.col(column), index)
    bit = F.expr("shiftleft(1, f)")
    removed = at("left", F.col("before")) - at("left", F.col("after"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("left", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (at("left", F.lit(0)) - at("left", bit) - removed).alias("redundant"),
        (at("left", F.lit(full) - bit) - at("left", F.lit(full))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", F.col("after"))).alias("good_lost"),
        (at("bad", F.col("before")) - at("bad", F.col("after"))).alias("toxic_lost"),
        at("shares", F.col("f")).alias("shapley"),
    )


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents (doc_id, text, lang)`` and ``labels (doc_id, quality, toxic)`` to one row for each
    part, order of the five filters and step; other columns are ignored, no documents give no rows.
    Repeated rows count as often as they are there; of equal ids none is smaller."""
    rows = documents.select("doc_id", "text", "lang")
    return interaction_report(subset_survivors(rows, labels.select("doc_id", "quality", "toxic")))
