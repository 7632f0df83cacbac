"""Models, pooling and resuming."""

import hashlib

import numpy as np
import pytest

from tests.conftest import SMALL
from vectrail.operators.embedding import (
    bad_ids,
    embed_articles,
    embed_by_length,
    embed_texts,
    embedding_input,
    hashing_model,
    length_batches,
    not_embedded,
)
from vectrail.operators.pooling import masked_mean_pool
from vectrail.plans.build import build_vectors
from vectrail.plans.catalog.standins import articles, token_vectors


def hashed(text, dim):
    out = np.zeros(dim)
    tokens = text.lower().split()
    for token in tokens:
        digest = hashlib.md5(token.encode()).hexdigest()
        out[int(digest[:8], 16) % dim] += -1 if int(digest[8], 16) % 2 else 1
    return out / max(1, len(tokens))


def length_model():
    """A model whose vector is the number of characters and of texts in its batch."""

    def predict(texts):
        return np.array([[len(t), len(texts)] for t in texts], dtype=np.float32)

    return predict


def test_built_in_model(spark):
    texts = ["One two  two", "", "Été x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = dict(embed_texts(df, hashing_model(16)).collect())
    for i, text in enumerate(texts):
        assert np.allclose(rows[i], hashed(text, 16))


def test_plugged_in_model_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(7)] + [(7, None)], "doc_id bigint, text string").coalesce(1)
    rows = dict(embed_texts(df, lambda: length_model(), batch_size=3).collect())
    assert [rows[i][0] for i in range(7)] == list(range(7))
    assert max(v[1] for v in rows.values() if v) <= 3
    assert rows[7] is None
    cut = dict(embed_texts(df.selectExpr("doc_id", "'a bb ccc' AS text"), lambda: length_model(), max_tokens=2).collect())
    assert cut[0][0] == 4


def test_prefix_and_ids(spark):
    df = spark.createDataFrame([("7", "t", " "), ("8", "t", "abc")], "pmid string, title string, abstract string")
    assert dict(embedding_input(df).collect()) == {7: "search_document: t", 8: "search_document: abc"}
    assert dict(embedding_input(df, prefix="").collect()) == {7: "t", 8: "abc"}
    bad = spark.createDataFrame([("x", "t", "a")], df.schema)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        embedding_input(bad).collect()


def test_second_run_embeds_nothing(spark, tmp_path):
    table = articles(spark, SMALL)
    path = str(tmp_path / "vectors")
    first = build_vectors(table.where("doc_id % 2 = 0"), hashing_model(8), path, slices=3)
    assert first.count() == 100
    both = build_vectors(table, hashing_model(8), path)
    assert both.count() == both.select("doc_id").distinct().count() == 200
    assert not_embedded(table, both).count() == 0
    again = build_vectors(table, hashing_model(8), path)
    assert again.count() == 200
    expected = dict(embed_articles(table, hashing_model(8)).collect())
    assert dict(again.collect()) == expected


@pytest.mark.parametrize("masked", [True, False])
def test_pooling_equals_numpy(spark, masked):
    tokens = token_vectors(spark, SMALL)
    groups = {}
    for r in tokens.collect():
        groups.setdefault(r["doc_id"], []).append((r["mask"], r["vec"]))
    # A document of which no token counts.
    extra = spark.createDataFrame([(10**6, 0, 0, [1.0] * 64)], tokens.schema)
    found = dict(masked_mean_pool(tokens.unionAll(extra).repartition(5), mask="mask" if masked else None).collect())
    for doc, members in groups.items():
        kept = [v for m, v in members if m or not masked]
        assert np.allclose(found[doc], np.mean(kept, axis=0), atol=1e-7) if kept else found[doc] is None
    assert found[10**6] == (None if masked else [1.0] * 64)


def test_another_model_fails_before_any_work(spark, tmp_path):
    table = articles(spark, SMALL).where("doc_id < 5")
    build_vectors(table, hashing_model(8), str(tmp_path / "v"))
    with pytest.raises(ValueError, match="16 dimensions, the table has 8"):
        build_vectors(articles(spark, SMALL), hashing_model(16), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 5


def test_pooling_scans_its_tokens_once(spark, capsys):
    masked_mean_pool(token_vectors(spark, SMALL)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1


def test_batches_of_like_length_pad_little(spark):
    lengths = np.array([len(r[0].split()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()])
    for budget in (2000, 16_384):
        batches = length_batches(lengths, budget)
        assert sorted(np.concatenate(batches)) == list(range(len(lengths)))
        padded = [len(b) * lengths[b].max() for b in batches]
        assert all(p <= budget or len(b) == 1 for p, b in zip(padded, batches))
        assert 1 - lengths.sum() / sum(padded) < 0.15
        # In their own order as many rows to a batch pad far more.
        size = -(-len(lengths) // len(batches))
        plain = sum(len(lengths[i : i + size]) * lengths[i : i + size].max() for i in range(0, len(lengths), size))
        assert plain > 2 * sum(padded)
    assert length_batches(np.array([], dtype=int), 10) == [] and len(length_batches(np.array([0, 0, 50]), 10)) == 2


def test_embedding_by_length_gives_the_same_vectors_in_order(spark):
    rows = [(i, "word " * (i * 7 % 60) + str(i), i % 3) for i in range(700)] + [(700, None, 1), (701, "", 2)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string, kind int").coalesce(3)
    model = hashing_model(32)
    for options in ({}, {"max_tokens": 5}):
        whole = embed_texts(texts, model, **options).collect()
        by_length = embed_by_length(texts, model, token_budget=500, buffer_rows=100, **options)
        assert by_length.columns == ["doc_id", "kind", "doc_vector"]
        assert by_length.collect() == whole
    assert embed_by_length(texts.limit(0), model).collect() == []


def test_ids_that_are_not_numbers_are_set_aside(spark, tmp_path):
    schema = "pmid string, title string, abstract string"
    rows = [("7", "t", "a"), ("x8", "t", "b"), ("x8", "t", "c"), (None, "t", "d"), ("9" * 30, "t", "e")]
    table = spark.createDataFrame(rows, schema)
    kept = embedding_input(table, prefix="", on_bad_id="skip")
    assert [tuple(r) for r in kept.collect()] == [(7, "a")]
    assert bad_ids(table).count() == 4
    path = str(tmp_path / "vectors")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        build_vectors(table, length_model, path)
    for more in (0, 1):
        table = table.unionByName(spark.createDataFrame([("8", "t", "f")] * more, schema))
        vectors = build_vectors(table, length_model, path, slices=2, on_bad_id="skip")
        assert sorted(r["doc_id"] for r in vectors.collect()) == [7, 8][: 1 + more]
    found = spark.read.parquet(f"{path}/_bad_ids").collect()
    assert {(r["pmid"], r["n"]) for r in found} == {("x8", 2), (None, 1), ("9" * 30, 1)}
    with pytest.raises(ValueError, match="on_bad_id"):
        embedding_input(table, on_bad_id="drop")
