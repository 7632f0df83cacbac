"""Language identification by a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes. Filters of several widths slide over the
embedded bytes, the maximum of each filter over a window goes through a softmax layer, and the mean
log probabilities of all windows of a text decide. The network is trained in numpy on windows of a
bounded sample of labelled texts and applied to all windows of all texts.

When applied, the convolution is a sum of lookups: what a filter gives for a pair of bytes at one
place is a table of 65,536 rows, so no window is ever multiplied with a matrix.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.folds import bounded_sample, held_out
from vectrail.scratch import written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
UNDETERMINED = "und"
#: Windows that are convolved at once.
TILE = 64


class ByteCNN:
    """Parameters and training of the network; ``names`` are the languages of the outputs."""

    def __init__(self, names: list[str], seed: int = 3):
        random = np.random.default_rng(seed)
        self.names = names
        self.parts = {"embed": random.normal(0, 0.5, (256, EMBEDDED))}
        for w in WIDTHS:
            self.parts[f"conv{w}"] = random.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS))
            self.parts[f"bias{w}"] = np.zeros(FILTERS)
        self.parts["dense"] = random.normal(0, 0.2, (FILTERS * len(WIDTHS), len(names)))
        self.parts["offset"] = np.zeros(len(names))
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int, seed: int = 3) -> None:
        """Adam on minibatches of cross entropy."""
        random = np.random.default_rng(seed)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.parts.items()}
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(windows))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                step += 1
                for k, g in self._gradients(windows[batch], labels[batch]).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    scale = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.parts[k] -= (scale * m / (np.sqrt(v) + 1e-7)).astype(np.float32)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.parts, len(windows)
        embedded = p["embed"][windows]
        pooled, picked = [], []
        for w in WIDTHS:
            places = windows.shape[1] - w + 1
            stacked = np.concatenate([embedded[:, j : j + places] for j in range(w)], axis=2)
            out = stacked @ p[f"conv{w}"]
            best = out.argmax(axis=1)
            picked.append((stacked, best))
            pooled.append(np.take_along_axis(out, best[:, None], axis=1)[:, 0] + p[f"bias{w}"])
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = hidden @ p["dense"] + p["offset"]
        error = np.exp(logits - logits.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(n), labels] -= 1
        error /= n
        grads = {"dense": hidden.T @ error, "offset": error.sum(axis=0)}
        back = (error @ p["dense"].T) * (hidden > 0)
        grads["embed"] = np.zeros_like(p["embed"])
        for i, (w, (stacked, best)) in enumerate(zip(WIDTHS, picked)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"bias{w}"] = own.sum(axis=0)
            seen = stacked[np.arange(n)[:, None], best]  # the patch each filter was largest on
            grads[f"conv{w}"] = np.einsum("nfk,nf->kf", seen, own)
            patch = own[:, :, None] * p[f"conv{w}"].T[None]
            for j in range(w):
                where = np.take_along_axis(windows, best + j, axis=1).ravel()
                part = patch[:, :, j * EMBEDDED : (j + 1) * EMBEDDED].reshape(-1, EMBEDDED)
                np.add.at(grads["embed"], where, part)
        return grads

    def tables(self) -> tuple:
        """The filters as lookups: for each width, a table for each pair (or last single) of bytes."""
        embed, out = self.parts["embed"], []
        for w in WIDTHS:
            conv, pairs = self.parts[f"conv{w}"], []
            single = [embed @ conv[j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w)]
            for j in range(0, w - 1, 2):
                both = (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS)
                pairs.append((j, True, np.ascontiguousarray(both, dtype=np.float32)))
            if w % 2:
                pairs.append((w - 1, False, np.ascontiguousarray(single[-1], dtype=np.float32)))
            out.append((w, pairs, self.parts[f"bias{w}"]))
        return out, self.parts["dense"], self.parts["offset"]


def log_probabilities(windows: np.ndarray, tables: tuple) -> np.ndarray:
    """Log softmax of each window, a row of bytes."""
    filters, dense, offset = tables
    out = np.empty((len(windows), len(offset)), dtype=np.float32)
    for at in range(0, len(windows), TILE):
        tile = windows[at : at + TILE].astype(np.int64)
        pairs = tile[:, :-1] * 256 + tile[:, 1:]
        pooled = []
        for w, lookups, bias in filters:
            places, total = tile.shape[1] - w + 1, None
            for j, paired, table in lookups:
                found = table.take((pairs if paired else tile)[:, j : j + places], axis=0)
                total = found if total is None else np.add(total, found, out=total)
            pooled.append(total.max(axis=1) + bias)
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ dense + offset
        logits -= logits.max(axis=1, keepdims=True)
        out[at : at + TILE] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return out


def cut_windows(data: bytes) -> np.ndarray:
    """All bytes of a text as rows of a window each; zeros fill the last one."""
    rows = -(-len(data) // WINDOW)
    padded = np.zeros(rows * WINDOW, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return padded.reshape(rows, WINDOW)


def _sample_windows(docs: DataFrame, per_language: int, windows: int, seed: int) -> pd.DataFrame:
    """Up to ``windows`` spread windows of up to ``per_language`` documents of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    # Texts are read for their letters once, however many languages there are.
    ids = written(labelled.select("doc_id", "lang"), "labelled-ids")
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for lang in sorted(counts):
        part = bounded_sample(ids.where(F.col("lang") == lang), "doc_id", per_language, seed)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return pd.DataFrame({"lang": [], "bytes": []})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for lang, text in zip(rows["lang"], rows["text"]):
                data = text.encode()
                for i in range(windows):
                    at = max(0, len(data) - WINDOW) * i // max(1, windows - 1)
                    out.append((lang, data[at : at + WINDOW]))
                    if len(data) <= WINDOW:
                        break
            yield pd.DataFrame(out, columns=["lang", "bytes"])

    # At most per_language ids for each language are broadcast.
    found = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = found.mapInPandas(cut, "lang string, bytes binary").toPandas()
    return rows.sort_values(["lang", "bytes"], ignore_index=True)


def train_language_model(
    docs: DataFrame,
    per_language: int = 600,
    windows: int = 4,
    epochs: int = 4,
    seed: int = 3,
) -> ByteCNN:
    """A network for the non-null ``lang`` values of ``docs``, from at most ``windows`` windows of at
    most ``per_language`` texts of each. Windows come once whole and once cut short at random, so
    that short texts are known too. Repeated rows count as often as they are drawn."""
    rows = _sample_windows(docs, per_language, windows, seed)
    names = sorted(rows["lang"].unique())
    model = ByteCNN(names, seed)
    if len(names) > 1:
        random = np.random.default_rng(seed)
        whole = np.zeros((len(rows), WINDOW), dtype=np.uint8)
        for i, data in enumerate(rows["bytes"]):
            whole[i, : len(data)] = np.frombuffer(data, dtype=np.uint8)
        short = np.where(np.arange(WINDOW) < random.integers(6, WINDOW, (len(rows), 1)), whole, 0)
        labels = rows["lang"].map({name: i for i, name in enumerate(names)}).to_numpy()
        model.train(np.concatenate([whole, short]), np.concatenate([labels, labels]), epochs, seed)
    return model


def has_letter(text: Column) -> Column:
    """Whether a text is there and has a letter."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; their other columns stay as they are.

    A text that is null or has no letter gets ``und`` with score 1. If the model knows no language, a
    text with letters gets null with score 0. All bytes of a text are read; a long text is one row and its windows
    pass in tiles. The model is broadcast; it has a fixed size but for one column a language.
    """
    spark = docs.sparkSession
    names, shared = model.names, spark.sparkContext.broadcast(model.tables())
    if not names:
        known = has_letter(F.col("text"))
        unknown = F.when(known, F.lit(None)).otherwise(UNDETERMINED)
        return docs.withColumn("lang_pred", unknown).withColumn("score", F.when(known, 0.0).otherwise(1.0))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = shared.value
        for texts in batches:
            out = []
            for group in _groups(texts):
                windows = [cut_windows(data) for data in group]
                starts = np.cumsum([0] + [len(w) for w in windows[:-1]])
                logs = log_probabilities(np.concatenate(windows), tables)
                sums = np.add.reduceat(logs, starts, axis=0)
                means = sums / np.array([len(w) for w in windows])[:, None]
                probable = np.exp(means - means.max(axis=1, keepdims=True))
                probable /= probable.sum(axis=1, keepdims=True)
                best = probable.argmax(axis=1)
                top = probable[np.arange(len(best)), best].astype(float)
                out.append(pd.DataFrame({"lang_pred": [names[i] for i in best], "score": top}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(
                {"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)}
            )

    known = has_letter(F.col("text"))
    # Texts without letters reach the model as one blank, so that each has a window.
    found = docs.withColumn("guess", guess(F.when(known, F.col("text")).otherwise(" ")))
    return (
        found.withColumn("lang_pred", F.when(known, F.col("guess.lang_pred")).otherwise(UNDETERMINED))
        .withColumn("score", F.when(known, F.col("guess.score")).otherwise(1.0))
        .drop("guess")
    )


def _groups(texts: pd.Series, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Texts in groups of some megabytes, a longer text on its own."""
    group, size = [], 0
    for text in texts:
        data = text.encode()
        if group and size + len(data) > most:
            yield group
            group, size = [], 0
        group.append(data)
        size += len(data)
    if group:
        yield group


def predict_languages(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``: learned outside the held-out fold."""
    learned = docs.where(~held_out(F.col("doc_id"), folds, fold)).select("doc_id", "text", "lang")
    model = train_language_model(learned)
    return identify(docs.withColumn("held_out", held_out(F.col("doc_id"), folds, fold)), model)
