"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text becomes a sparse vector: its distinct words and their shapes (letters, digits, marks), hashed,
its length class as metadata, and a few structure statistics as values. The machine adds a weight per
feature and, for each pair of features, the product of their low-rank factors; the identity
``sum over pairs = ((sum v x)^2 - sum (v x)^2) / 2`` scores this in time linear in the features.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.folds import bounded_sample, held_out

SLOTS = 1 << 16
FACTORS = 8
LENGTH_CLASSES = 32
#: Hashed slots, then length classes, then structure statistics.
STATISTICS = 10
FEATURES = SLOTS + LENGTH_CLASSES + STATISTICS
CACHED = 200_000

_SHAPE = bytes(
    97 if chr(c).isascii() and chr(c).isalpha() or c >= 128 else 48 if 48 <= c < 58 else c
    for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_ALPHA = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128)
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


class _Slots(dict):
    """The two slots of a word: itself and its shape with runs shortened."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))
        slots = (zlib.crc32(word) % SLOTS, zlib.crc32(b"\0" + shape) % SLOTS)
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = slots
        return slots


def text_features(data: bytes, slots: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text, all of it read."""
    words = data.lower().split()
    found = {s for word in set(words) for s in slots[word]}
    hashed = np.fromiter(found, dtype=np.int32, count=len(found))
    hashed.sort()
    size, n = max(len(data), 1), max(len(words), 1)
    lines = data.split(b"\n")
    letters = size - len(data.translate(None, _ALPHA))
    statistics = np.array(
        [
            1 - letters / size,
            (size - len(data.translate(None, _DIGITS))) / size,
            (size - len(data.translate(None, _UPPER))) / size,
            min(size / n, 40) / 10,
            len(set(words)) / n,
            len(set(lines)) / len(lines),
            min(size / len(lines), 2000) / 500,
            data.count(b".") / n,
            data.count(b",") / n,
            1.0,
        ],
        dtype=np.float32,
    )
    length = SLOTS + min(len(data).bit_length(), LENGTH_CLASSES - 1)
    index = np.concatenate([hashed, [length], np.arange(FEATURES - STATISTICS, FEATURES)])
    value = np.concatenate([np.full(len(hashed), max(len(hashed), 1) ** -0.5), [1.0], statistics])
    return index.astype(np.int32), value.astype(np.float32)


def fm_scores(model: tuple, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple:
    """Logits of texts whose features lie behind each other, and the factor sums."""
    bias, weight, factors = model
    scaled = factors[index] * value[:, None]
    sums = np.add.reduceat(scaled, starts, axis=0)
    squares = np.add.reduceat(scaled * scaled, starts, axis=0)
    linear = np.add.reduceat(weight[index] * value, starts)
    return bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums, scaled


def train_fm(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int):
    """Adagrad on minibatches of log loss."""
    random = np.random.default_rng(seed)
    weight = np.zeros(FEATURES, np.float32)
    factors = random.normal(0, 0.02, (FEATURES, FACTORS)).astype(np.float32)
    seen_w = np.full(FEATURES, 1e-3, np.float32)
    seen_v = np.full((FEATURES, FACTORS), 1e-3, np.float32)
    share = min(max(labels.mean(), 0.01), 0.99) if len(labels) else 0.5
    bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            index = np.concatenate([texts[i][0] for i in batch])
            value = np.concatenate([texts[i][1] for i in batch])
            sizes = np.array([len(texts[i][0]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            logit, sums, scaled = fm_scores((bias, weight, factors), index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]).astype(np.float32)
            each = np.repeat(error, sizes) * value
            rows = np.repeat(np.arange(len(batch)), sizes)
            slots, back = np.unique(index, return_inverse=True)
            grad_w = np.bincount(back, each, len(slots)).astype(np.float32) / len(batch)
            pull = each[:, None] * (sums[rows] - scaled)
            grad_v = np.zeros((len(slots), FACTORS), np.float32)
            np.add.at(grad_v, back, pull / len(batch))
            grad_w += 1e-5 * weight[slots]
            grad_v += 1e-5 * factors[slots]
            seen_w[slots] += grad_w**2
            seen_v[slots] += grad_v**2
            weight[slots] -= 0.1 * grad_w / np.sqrt(seen_w[slots])
            factors[slots] -= 0.02 * grad_v / np.sqrt(seen_v[slots])
            bias -= 0.05 * float(error.mean())
    return bias, weight, factors


def train_quality_model(docs: DataFrame, labels: DataFrame, most: int = 6000, epochs: int = 6, seed: int = 2):
    """A model of ``label`` (0 or 1) from at most ``most`` labelled documents, half from each label.

    ``labels`` has ``(doc_id, label)``; null labels are left out and the largest label of a repeated
    id counts. Without both labels the model gives the share of label 1, or 0.5.
    """
    one = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    one = one.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = None
    for label in (0, 1):
        part = bounded_sample(one.where(F.col("label") == label), "doc_id", most // 2, seed)
        chosen = part if chosen is None else chosen.unionByName(part)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = _Slots()
        for rows in batches:
            out = [text_features((t or "").encode(), slots) for t in rows["text"]]
            yield rows[["doc_id", "label"]].assign(
                slots=[i.tobytes() for i, _ in out], shares=[v.tobytes() for _, v in out]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # At most ``most`` ids are broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.mapInPandas(
        extract, f"doc_id {kind}, label int, slots binary, shares binary"
    ).toPandas()
    rows = rows.sort_values(["doc_id", "slots"], ignore_index=True)
    texts = [
        (np.frombuffer(i, np.int32), np.frombuffer(v, np.float32))
        for i, v in zip(rows["slots"], rows["shares"])
    ]
    return train_fm(texts, rows["label"].to_numpy().astype(np.float32), epochs, seed)


def score_quality(docs: DataFrame, model: tuple) -> DataFrame:
    """``(doc_id, score)`` of every document; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = _Slots()
        for rows in batches:
            out = np.empty(len(rows))
            for at in range(0, len(rows), 64):
                texts = [text_features((t or "").encode(), slots) for t in rows.iloc[at : at + 64]]
                starts = np.cumsum([0] + [len(i) for i, _ in texts[:-1]])
                index, value = (np.concatenate(x) for x in zip(*texts))
                out[at : at + 64] = fm_scores(shared.value, index, value, starts)[0]
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.select("doc_id", score("text").alias("score"))


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``, learned from ``labels``
    ``(doc_id, label)`` outside the held-out fold."""
    learned = labels.where(~held_out(F.col("doc_id"), folds, fold))
    model = train_quality_model(docs, learned)
    return score_quality(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
