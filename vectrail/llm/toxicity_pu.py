"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positive, all other texts are unlabelled: some of them are toxic too. Texts
are sets of hashed forms: words, their beginnings, and letter n-grams at every place of what has no
blanks. A lexicon keeps the forms that are surely more frequent among the positives. A numpy classifier
has a weight for each of them, and for what their odds in a text sum up to, all trained on the
non-negative risk of positive-unlabelled learning: the risk of the negatives is that of the unlabelled
less the share of the positives in it, and where this estimate falls below zero its gradient is turned.
"""

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.folds import bounded_sample, held_out
from vectrail.scratch import written

#: Beginnings of words that stand for all words with them, in code points.
BEGINNINGS = (4, 5, 6)
#: A run of more letters, or one in a script without blanks, has n-grams at every place.
LONG_RUN = 24
GRAMS = (2, 3, 4, 5, 6)
INPUTS = 11
THRESHOLD = 0.7
CACHED = 200_000
#: Forms of a text that are told apart at once while the lexicon is counted.
FORMS_AT_ONCE = 1 << 20
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_RUN = re.compile(r"[^\W_]+")
# Thai, Lao, Burmese, Khmer, kana and Han are written without blanks.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def _hashed(form: str) -> int:
    return zlib.crc32(form.encode("utf-8", "surrogatepass"))


def _run_forms(run: str) -> Iterator[str]:
    if _UNSPACED.search(run):
        sizes = GRAMS
    elif len(run) > LONG_RUN:
        sizes = BEGINNINGS
    else:
        yield from (run[:n] + "*" for n in BEGINNINGS if len(run) > n)
        return
    for n in sizes:
        for i in range(len(run) - n + 1):
            gram = run[i : i + n]
            # Inside a run a word may end here or go on, so it is looked up as both.
            yield gram
            yield gram + "*"


def word_forms(word: str) -> Iterator[int]:
    """Hashed forms of what blanks part, all of it read: the whole without marks around it, each run
    of letters and digits in it, and of each run its beginnings, marked as such, or its n-grams."""
    plain = word.strip(_MARKS)
    if plain:
        yield _hashed(plain)
        for run in _RUN.findall(plain):
            if run != plain:
                yield _hashed(run)
            yield from map(_hashed, _run_forms(run))


class _Forms(dict):
    """The forms of a word that the lexicon has, and the largest weight of these."""

    def __init__(self, lexicon: dict[int, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, frozenset[int]]:
        known = frozenset(f for f in word_forms(word) if f in self.lexicon)
        found = max((self.lexicon[f] for f in known), default=0.0), known
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = found
        return found


def text_inputs(text: str, forms: _Forms) -> tuple[list[float], list[int]]:
    """Inputs of the classifier from all distinct words of a text, and its forms in the lexicon."""
    words = set(text.lower().split())
    each = [forms[w] for w in words]
    found = sorted((weight for weight, _ in each if weight > 0), reverse=True)
    top = (found + [0.0] * 4)[:4]
    size = np.log1p(len(words)) / 10
    rate = sum(found) / (5 + len(words)) ** 0.5
    dense = 10 / (20 + len(words))
    inputs = top + [
        np.log1p(sum(found)),
        np.log1p(len(found)),
        rate,
        dense * sum(found),
        dense * len(found),
        size,
        1.0,
    ]
    return inputs, sorted(frozenset().union(*(known for _, known in each)))


def _lexicon(sample: DataFrame, n_positive: int, n_other: int, sure: float, most: int) -> dict[int, float]:
    """Forms whose log odds among the positives stay above 0 by ``sure`` standard errors.

    A form counts once a text, or once in each ``FORMS_AT_ONCE`` different ones of a very long text.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(found: Iterable[int], positive: bool) -> pd.DataFrame:
            return pd.DataFrame({"form": np.fromiter(found, np.int64), "positive": positive})

        for rows in batches:
            for positive, text in zip(rows["positive"], rows["text"]):
                found = set()
                for word in set((text or "").lower().split()):
                    for form in word_forms(word):
                        found.add(form)
                        if len(found) >= FORMS_AT_ONCE:
                            yield frame(found, positive)
                            found.clear()
                yield frame(found, positive)

    counts = (
        sample.mapInPandas(counted, "form long, positive boolean")
        .groupBy("form")
        .agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
        .where(F.col("p") >= 3)
    )
    p, u = F.col("p") + 0.5, F.col("u") + 0.5
    odds = F.log(p / (n_positive + 1)) - F.log(u / (n_other + 1))
    kept = counts.select("form", (odds - sure * F.sqrt(1 / p + 1 / u)).alias("weight"))
    best = kept.where("weight > 0").orderBy(F.desc("weight"), "form").limit(most)
    return {r["form"]: r["weight"] for r in best.collect()}


class Rows:
    """Texts as a matrix of inputs beside sparse rows of lexicon forms.

    A form of a text has the value 1 over the root of the number of its forms, so that their sum
    cannot grow without bound.
    """

    def __init__(self, inputs: np.ndarray, forms: list[np.ndarray], n_forms: int):
        sizes = np.array([len(f) for f in forms], dtype=np.int64)
        self.inputs, self.n_forms, self.n = inputs, n_forms, len(inputs)
        self.at = np.repeat(np.arange(len(forms)), sizes)
        self.form = np.concatenate([np.array([], dtype=np.int64), *forms]).astype(np.int64)
        self.value = np.repeat(np.maximum(sizes, 1) ** -0.5, sizes)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        linear = self.inputs @ weight[:INPUTS]
        return linear + np.bincount(self.at, weight[INPUTS:][self.form] * self.value, self.n)

    def pull(self, each: np.ndarray) -> np.ndarray:
        """The gradient of the weights where that of the scores is ``each``."""
        forms = np.bincount(self.form, each[self.at] * self.value, self.n_forms)
        return np.concatenate([each @ self.inputs, forms])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nnpu_step(weight: np.ndarray, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, float, np.ndarray]:
    """``(risk of the positives, risk of the negatives, gradient)`` with log loss.

    The gradient is that of both risks, or where the second, as estimated from the unlabelled less the
    positives among them, is below zero, that of the second one turned.
    """
    score_p, score_u = positive.scores(weight), unlabelled.scores(weight)
    n_p, n_u = positive.n, max(unlabelled.n, 1)
    as_positive = prior * np.logaddexp(0, -score_p).mean()
    as_negative = np.logaddexp(0, score_u).sum() / n_u - prior * np.logaddexp(0, score_p).mean()
    on_p, on_u = _sigmoid(score_p), _sigmoid(score_u)
    negative = unlabelled.pull(on_u / n_u) - positive.pull(prior * on_p / n_p)
    if as_negative < 0:
        return as_positive, as_negative, -negative
    return as_positive, as_negative, negative - positive.pull(prior * (1 - on_p) / n_p)


def train_nnpu(positive: Rows, unlabelled: Rows, prior: float, epochs: int = 400) -> np.ndarray:
    """Weights of inputs and forms of a logistic classifier by the non-negative risk, Adam on full
    batches."""
    weight, m, v = (np.zeros(INPUTS + positive.n_forms) for _ in range(3))
    decay = np.concatenate([np.full(INPUTS, 1e-4), np.full(positive.n_forms, 1e-3)])
    rate = np.concatenate([np.full(INPUTS, 0.1), np.full(positive.n_forms, 0.01)])
    for step in range(1, epochs + 1):
        grad = nnpu_step(weight, positive, unlabelled, prior)[2] + decay * weight
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weight


def train_toxicity_model(
    docs: DataFrame,
    positives: DataFrame,
    prior: float,
    most_positive: int = 3000,
    most_unlabelled: int = 6000,
    sure: float = 4.0,
    most_forms: int = 20_000,
    seed: int = 9,
) -> tuple[dict[int, float], np.ndarray]:
    """Lexicon and classifier from at most so many confirmed and other documents of ``docs``.

    ``positives`` has the ids of the confirmed ones, ``prior`` is the share of toxic texts among
    all. Without positives, nothing is toxic: the lexicon is empty and the score low.
    """
    toxic = positives.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    chosen = bounded_sample(toxic, "doc_id", most_positive, seed).withColumn("positive", F.lit(True))
    some = bounded_sample(docs.select("doc_id").where(F.col("doc_id").isNotNull()), "doc_id", most_unlabelled, seed)
    both = chosen.unionByName(some.distinct().withColumn("positive", F.lit(False)))
    # At most most_positive + most_unlabelled ids are broadcast.
    sample = written(
        docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").select("doc_id", "positive", "text"),
        "toxicity-sample",
    )
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not n.get(True):
        return {}, np.array([0.0] * (INPUTS - 1) + [-5.0])
    lexicon = _lexicon(sample, n[True], n.get(False, 0), sure, most_forms)

    def inputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = _Forms(lexicon)
        for rows in batches:
            found = [text_inputs(t or "", forms) for t in rows["text"]]
            own, known = [i for i, _ in found], [f for _, f in found]
            yield pd.DataFrame(
                {"doc_id": rows["doc_id"], "positive": rows["positive"], "inputs": own, "forms": known}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, positive boolean, inputs array<double>, forms array<long>"
    # At most most_positive + most_unlabelled rows, of at most most_forms forms each.
    rows = sample.mapInPandas(inputs, schema).toPandas().sort_values(["doc_id", "positive"])
    order = np.array(sorted(lexicon), dtype=np.int64)

    def part(some: pd.DataFrame) -> Rows:
        matrix = np.array(some["inputs"].tolist()).reshape(-1, INPUTS)
        places = [np.searchsorted(order, np.array(f, dtype=np.int64)) for f in some["forms"]]
        return Rows(matrix, places, len(order))

    is_positive = rows["positive"].to_numpy().astype(bool)
    return lexicon, train_nnpu(part(rows[is_positive]), part(rows[~is_positive]), prior)


def score_toxicity(docs: DataFrame, model: tuple[dict[int, float], np.ndarray]) -> DataFrame:
    """``(doc_id, score)`` of every document; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by most_forms

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, weight = shared.value
        forms, order = _Forms(lexicon), np.array(sorted(lexicon), dtype=np.int64)
        for texts in batches:
            found = [text_inputs(t or "", forms) for t in texts]
            matrix = np.array([i for i, _ in found]).reshape(-1, INPUTS)
            places = [np.searchsorted(order, np.array(f, dtype=np.int64)) for _, f in found]
            yield pd.Series(_sigmoid(Rows(matrix, places, len(order)).scores(weight)))

    return docs.select("doc_id", score("text").alias("score"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; ``labels`` ``(doc_id, label)``
    confirms texts as toxic outside the held-out fold. The prior is the share of label 1 there."""
    outside = ~held_out(F.col("doc_id"), folds, fold)
    learned = labels.where(outside & F.col("label").isNotNull())
    seen = learned.agg(F.avg(F.col("label").cast("double"))).first()[0]
    prior = min(max(seen or 0.0, 0.01), 0.5)
    model = train_toxicity_model(docs.where(outside), learned.where("label = 1"), prior)
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
