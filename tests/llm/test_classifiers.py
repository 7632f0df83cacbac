"""Quality, language and toxicity: held-out accuracy, edge rows, columns that must not matter."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vectrail.llm import folds, lang_cnn, quality_fm, toxicity_pu
from vectrail.llm.folds import bounded_sample, held_out

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score string, label string"
EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "12 345 !!"), (9005, "a"), (None, "no id"), (9006, "x" * 300_000)]
EDGES += [(9007, "same words"), (9007, "same words"), (2**60 + 1, "large id")]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    edges = spark.createDataFrame([(i, t, None, None, "s", "l") for i, t in EDGES], SCHEMA)
    more = table.withColumn("score", F.lit("s")).withColumn("label", F.lit("l"))
    return more.unionByName(edges).cache()


def labels(spark, name):
    return spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col(name).alias("label"))


def check_rows(docs, found):
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids(found) == ids(docs.select("doc_id").collect())
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % r["folds"] == r["fold"])


@pytest.mark.parametrize(
    "classify, name, bar, least",
    [(quality_fm.classify_quality, "quality", 0.5, 0.9), (toxicity_pu.classify_toxicity, "toxic", 0.7, 0.94)],
)
def test_labels_are_learned(spark, docs, classify, name, bar, least):
    found = classify(docs, labels(spark, name)).withColumns({"folds": F.lit(3), "fold": F.lit(1)}).collect()
    check_rows(docs, found)
    assert all(r["predicted"] == int(r["score"] >= bar) for r in found)
    truth = {r["doc_id"]: r["label"] for r in labels(spark, name).collect()}
    hits = [r["predicted"] == truth[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(hits) > 80 and np.mean(hits) >= least
    # Labels of the held-out fold change nothing.
    blind = labels(spark, name).where(~held_out(F.col("doc_id"), 3, 1))
    again = {(r["doc_id"], r["score"]) for r in classify(docs.drop("lang", "source"), blind).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in found}


def test_languages_are_learned(docs):
    found = lang_cnn.predict_languages(docs).withColumns({"folds": F.lit(4), "fold": F.lit(2)}).collect()
    check_rows(docs, found)
    hits = [r["lang_pred"] == r["lang"] for r in found if r["held_out"] and r["lang"]]
    assert len(hits) > 200 and np.mean(hits) >= 0.97
    told = {r["doc_id"]: r["lang_pred"] for r in found}
    assert all(told[i] == "und" for i in (9001, 9002, 9003, 9004)) and told[9005] in ("de", "en", "es", "fr")


def test_empty_tables_and_missing_labels(spark, docs):
    none, few = docs.limit(0), docs.limit(5)
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    assert quality_fm.classify_quality(none, no_labels).count() == 0
    assert toxicity_pu.classify_toxicity(none, no_labels).count() == 0
    assert lang_cnn.predict_languages(none).count() == 0
    assert quality_fm.classify_quality(few, no_labels).count() == 5
    assert {r["predicted"] for r in toxicity_pu.classify_toxicity(few, no_labels).collect()} == {0}
    unlabelled = few.withColumn("lang", F.lit(None).cast("string"))
    # No language is known, so a text with letters has none; one without stays undetermined.
    assert {r["lang_pred"] for r in lang_cnn.predict_languages(unlabelled).collect()} == {None}
    blank = lang_cnn.predict_languages(unlabelled.withColumn("text", F.lit("12 ;")))
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}


def test_factorisation_equals_sum_over_pairs():
    some = np.random.default_rng(2)
    model = (0.3, some.normal(size=quality_fm.FEATURES), some.normal(size=(quality_fm.FEATURES, 8)))
    index, value = some.choice(quality_fm.FEATURES, 12, replace=False), some.normal(size=12)
    logit = quality_fm.fm_scores(model, index, value, np.array([0]))[0][0]
    expected = 0.3 + model[1][index] @ value
    for i in range(12):
        for j in range(i):
            expected += model[2][index[i]] @ model[2][index[j]] * value[i] * value[j]
    assert abs(logit - expected) < 1e-9


def nnpu_rows(some, n):
    forms = [np.unique(some.integers(0, 5, some.integers(0, 5))) for _ in range(n)]
    return toxicity_pu.Rows(some.normal(size=(n, toxicity_pu.INPUTS)), forms, 5), forms


@pytest.mark.parametrize("prior, turned", [(0.1, False), (0.5, True)])
def test_nnpu_risk_and_gradient_equal_a_plain_version(prior, turned):
    some = np.random.default_rng(9)
    (positive, forms_p), (unlabelled, forms_u) = nnpu_rows(some, 7), nnpu_rows(some, 9)
    if turned:  # what is unlabelled is scored low, and the positives high
        positive.inputs[:, 0], unlabelled.inputs[:, 0] = 9, -9
    weight = some.normal(size=toxicity_pu.INPUTS + 5) * 0.3
    weight[0] = 1.0

    def score(rows, forms, i, weight):
        known = sum(weight[toxicity_pu.INPUTS + f] for f in forms[i]) / max(1, len(forms[i])) ** 0.5
        return sum(a * b for a, b in zip(rows.inputs[i], weight)) + known

    def loss(x):  # of a score taken as positive
        return float(np.log(1 + np.exp(-x)))

    def risks(weight):
        p = [score(positive, forms_p, i, weight) for i in range(7)]
        u = [score(unlabelled, forms_u, i, weight) for i in range(9)]
        first = prior * sum(map(loss, p)) / 7
        return first, sum(loss(-x) for x in u) / 9 - prior * sum(loss(-x) for x in p) / 7

    found_p, found_n, gradient = toxicity_pu.nnpu_step(weight, positive, unlabelled, prior)
    assert np.allclose((found_p, found_n), risks(weight)) and (found_n < 0) == turned
    for i in range(len(weight)):
        step = np.zeros(len(weight))
        step[i] = 1e-5
        up, down = risks(weight + step), risks(weight - step)
        plain = -(up[1] - down[1]) if turned else sum(up) - sum(down)
        assert abs(gradient[i] - plain / 2e-5) < 1e-6


def test_words_are_known_wherever_they_stand(spark, docs):
    forms = lambda text: set(toxicity_pu.word_forms(text))
    assert forms("idiot") <= forms("fine,idiot") and forms("idiot") <= forms("x" * 10_000 + "idiot")
    assert forms("\u50bb\u74dc") <= forms("\u4f60" * 70 + "\u50bb\u74dc")
    assert not forms("...") and not forms("")
    truth = labels(spark, "toxic")
    model = toxicity_pu.train_toxicity_model(docs, truth.where("label = 1"), 0.1)
    words = "idiot scum pathetic loser"
    filler = "abcdefghijklmnopqrstuvwxyz" * 400
    texts = [words, words.replace(" ", ","), filler + words.replace(" ", ""), filler, "", "fine," * 2000 + words.replace(" ", "-")]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = dict(toxicity_pu.score_toxicity(asked, model).collect())
    assert min(scores[0], scores[1], scores[2], scores[5]) >= 0.7 and max(scores[3], scores[4]) < 0.5


def test_shapes_and_hashes_of_words_are_of_the_whole():
    slots = quality_fm._Slots()
    assert slots[b"a" * 70 + b"#"] != slots[b"a" * 70 + b"9"]
    assert slots[b"a" * 70 + b"#"][1] == slots[b"b#"][1]


def test_a_bounded_sample_is_the_lowest_hashes_whatever_the_cells(spark):
    rows = spark.range(0, 20_000, 1, 64).selectExpr("if(id % 3 = 0, -7, id) AS key", "id")
    mixed = F.xxhash64("key", F.lit(5))
    for n in (1, 10, 300, 5000, 50_000):
        whole = [r["key"] for r in rows.orderBy(mixed, "key").limit(n).select("key").collect()]
        assert [r["key"] for r in bounded_sample(rows, "key", n, 5).collect()] == whole
    # What reaches the last task is bounded however many partitions there are, also far down the cells.
    bound = folds._hash_bound(rows.where("key >= 0").select(mixed.alias("hash")), 10)
    assert 10 <= rows.where("key >= 0").where(mixed <= bound).count() <= 40
    narrow = spark.range(0, 5000).selectExpr("id - 9000000000000000000 AS hash")
    bound = folds._hash_bound(narrow, 10)
    assert 10 <= narrow.where(F.col("hash") <= bound).count() <= 40
    assert folds._hash_bound(narrow.limit(0), 10) is None and bounded_sample(rows.limit(0), "key", 3, 1).count() == 0


def test_lookups_equal_the_network():
    model = lang_cnn.ByteCNN(["a", "b", "c"])
    windows = np.random.default_rng(1).integers(0, 256, (5, lang_cnn.WINDOW)).astype(np.uint8)
    p, pooled = model.parts, []
    for w in lang_cnn.WIDTHS:
        places = lang_cnn.WINDOW - w + 1
        out = [p["embed"][windows[:, i : i + w]].reshape(5, -1) @ p[f"conv{w}"] for i in range(places)]
        pooled.append(np.max(out, axis=0) + p[f"bias{w}"])
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ p["dense"] + p["offset"]
    logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(lang_cnn.log_probabilities(windows, model.tables()), logs, atol=1e-4)


def test_registered_queries_return_the_columns_asked_for(spark):
    found = {n: f for n, f in entry.queries().items() if n.startswith(("op2_", "op3_", "op9_"))}
    assert len(found) == 3
    for name, query in found.items():
        columns = {"doc_id", "held_out", "score", "lang_pred" if name.startswith("op3_") else "predicted"}
        assert columns <= set(query(spark, "/root/testdata/sf0.001").columns)
