"""Turning text into vectors with a pluggable batch model."""

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions import text as X
from vectrail.schema import DOC_ID, DOC_VECTOR, QUERY_ID, QUERY_VECTOR
from vectrail.scratch import written

# A model is a function without arguments, called once per Python worker. It loads what it needs
# and returns the function that maps an array of texts to a float32 matrix, one row per text.
MakeModel = Callable[[], Callable[[np.ndarray], np.ndarray]]

#: How much longer than the shortest text of a batch its longest may be.
STRETCH = 1.25


def hashing_model(dim: int) -> MakeModel:
    """The built-in model: signed feature hashing of lower-cased tokens, averaged over the text.

    A token adds +1 or -1 to one of ``dim`` buckets. The first eight hex digits of its MD5 give the
    bucket, the ninth the sign (even is +1). A text without tokens becomes the zero vector.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        def place(token: bytes) -> int:
            # Tokens counted with a plus come first, those with a minus dim places later.
            digest = hashlib.md5(token, usedforsecurity=False).digest()
            return int.from_bytes(digest[:4], "big") % dim + (digest[4] >> 4) % 2 * dim

        def predict(texts: np.ndarray) -> np.ndarray:
            # Bytes are split at ASCII whitespace only. Each distinct token of the batch is hashed
            # once, and one count over all tokens serves all texts.
            words = [text.lower().encode().split() for text in texts]
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            tokens = list(chain.from_iterable(words))
            known = {token: place(token) for token in set(tokens)}
            places = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
            rows = np.repeat(np.arange(len(words)), sizes)
            counts = np.bincount(rows * 2 * dim + places, minlength=len(words) * 2 * dim)
            counts = counts.reshape(len(words), 2, dim)
            signed = counts[:, 0] - counts[:, 1]
            return (signed / np.maximum(sizes, 1)[:, None]).astype(np.float32)

        return predict

    return make


def numeric_id(on_bad_id: str) -> Column:
    """The id as a number; another one fails, or with ``skip`` is NULL."""
    if on_bad_id not in ("error", "skip"):
        raise ValueError(f"on_bad_id must be 'error' or 'skip', not {on_bad_id!r}")
    return F.col("pmid").cast("bigint") if on_bad_id == "error" else F.col("pmid").try_cast("bigint")


def bad_ids(articles: DataFrame) -> DataFrame:
    """The articles that have no vector of their own with ``on_bad_id='skip'``: no number as id."""
    return articles.where(numeric_id("skip").isNull())


def embedding_input(
    articles: DataFrame, prefix: str = X.DOCUMENT_PREFIX, on_bad_id: str = "error"
) -> DataFrame:
    """``(doc_id, text)`` as the model sees it: the abstract, or else the title, with its prefix.

    Fails on an id that is not a number, or with ``on_bad_id='skip'`` leaves its article out;
    :func:`bad_ids` has those.
    """
    doc_id = numeric_id(on_bad_id)
    if on_bad_id == "skip":
        articles = articles.where(doc_id.isNotNull())
    return articles.select(
        doc_id.alias(DOC_ID),
        X.with_prefix(X.embedding_text(F.col("title"), F.col("abstract")), prefix).alias("text"),
    )


def embed_texts(
    texts: DataFrame,
    model: MakeModel,
    *,
    text: str = "text",
    vector: str = DOC_VECTOR,
    batch_size: int = 256,
    max_tokens: int | None = None,
    rebalance: bool = False,
) -> DataFrame:
    """Replace the text column by its vector; a NULL text has a NULL vector.

    Rows stay where they are: there is no shuffle, and each worker loads the model once.
    ``rebalance`` evens out the tasks first, which pays off when the table lies in few or uneven
    pieces, as the model costs far more than moving its texts.
    """
    if rebalance:
        texts = texts.hint("rebalance")
    content = F.col(text) if max_tokens is None else X.truncate_tokens(F.col(text), max_tokens)
    predict = predict_batch_udf(model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    others = [c for c in texts.columns if c != text]
    embedded = predict(F.coalesce(content, F.lit("")))
    return texts.select(*others, F.when(F.col(text).isNotNull(), embedded).alias(vector))


def length_batches(lengths: np.ndarray, token_budget: int) -> list[np.ndarray]:
    """Rows in batches of like length, none of more padded tokens than the budget, but one row at least.

    A model pads a batch to its longest text, so a batch of n texts costs n times its longest. The
    longest is at most ``STRETCH`` times the shortest, and some tokens more.
    """
    order = np.argsort(lengths, kind="stable")
    batches, first = [], 0
    for at in range(1, len(order) + 1):
        # In this order the last row is the longest.
        if (
            at == len(order)
            or (at - first + 1) * max(1, lengths[order[at]]) > token_budget
            or lengths[order[at]] > STRETCH * lengths[order[first]] + 8
        ):
            batches.append(order[first:at])
            first = at
    return batches


def embed_by_length(
    texts: DataFrame,
    model: MakeModel,
    *,
    text: str = "text",
    vector: str = DOC_VECTOR,
    token_budget: int = 16_384,
    buffer_rows: int = 4096,
    max_tokens: int | None = None,
    rebalance: bool = False,
) -> DataFrame:
    """The same as :func:`embed_texts`, in batches of texts of like length for models that pad.

    A task gathers ``buffer_rows`` rows, hands their texts to the model in batches of at most
    ``token_budget`` tokens with padding, tokens being what blanks part, and returns the rows in their
    old order. A longer text is a batch of its own.
    """
    if rebalance:
        texts = texts.hint("rebalance")
    content = F.col(text) if max_tokens is None else X.truncate_tokens(F.col(text), max_tokens)
    kept = texts.withColumn(text, content)
    others = [c for c in texts.columns if c != text]
    at = kept.columns.index(text)

    def embed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, held, rows = model(), [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = table.column(at).to_pylist()
            known = [i for i, value in enumerate(column) if value is not None]
            words = np.array([column[i] for i in known], dtype=object)
            vectors: list = [None] * len(column)
            for batch in length_batches(np.array([len(w.split()) for w in words], dtype=np.int64), token_budget):
                for i, found in zip(batch, predict(words[batch])):
                    vectors[known[i]] = found
            made = pa.array(vectors, type=pa.list_(pa.float32()))
            held.clear()
            return table.remove_column(at).append_column(vector, made).to_batches()[0]

        for batch in batches:
            for start in range(0, len(batch), buffer_rows):
                held.append(batch.slice(start, buffer_rows))
                rows += len(held[-1])
                if rows >= buffer_rows:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    schema = T.StructType([*(kept.schema[c] for c in others), T.StructField(vector, T.ArrayType(T.FloatType()))])
    return kept.mapInArrow(embed, schema)


def embed_articles(articles: DataFrame, model: MakeModel, **options) -> DataFrame:
    """The vector table of an article table; ``options`` are those of both steps."""
    own = {name: options.pop(name) for name in ("prefix", "on_bad_id") if name in options}
    return embed_texts(embedding_input(articles, **own), model, **options)


def embed_queries(
    queries: DataFrame, model: MakeModel, *, prefix: str = X.QUERY_PREFIX, **options
) -> DataFrame:
    """``(query_id, query_vector)`` of ``(query_id, text)``."""
    prefixed = queries.select(QUERY_ID, X.with_prefix(F.col("text"), prefix).alias("text"))
    return embed_texts(prefixed, model, vector=QUERY_VECTOR, **options)


def not_embedded(articles: DataFrame, vectors: DataFrame, on_bad_id: str = "error") -> DataFrame:
    """The articles that have no vector yet, whatever the order either table is read in.

    An id that is not a number fails, or with ``on_bad_id='skip'`` its article is left out.

    Ids alone are compared first, so that only the texts of what is missing meet a join; Spark
    broadcasts the missing ids if they are few.
    """
    key = numeric_id(on_bad_id)
    if on_bad_id == "skip":
        articles = articles.where(key.isNotNull())
    missing = articles.select(key.alias(DOC_ID)).join(vectors.select(DOC_ID), DOC_ID, "left_anti")
    missing = written(missing.distinct(), "not-embedded")
    keyed = articles.withColumn(DOC_ID, key)
    return keyed.join(missing, DOC_ID, "left_semi").select(*articles.columns)
