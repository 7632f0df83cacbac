"""The language stage drops nothing but texts without letters."""

import corpus_pipeline as P
from tests.llm.test_pipeline import DATA, SCHEMA


def test_exactly_the_texts_without_letters_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "'s' AS score", "1L AS _row")
    # Words of several languages, and of none, leave the model unsure.
    short = ["ok", "a", "die the la", "le der of que", "und et and y", "zq xv", "no si ja oui", "der le", "x1", "é ñ ü w"]
    more = [(6000 + i, t, None, "src0", len(t), "s", 1) for i, t in enumerate(short)]
    more += [(5001, None, None, None, None, "s", 1), (5002, "123 456", "en", "src0", 7, "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    expected = {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    kept = {r["doc_id"] for r in P.keep_known_languages(spark, docs, DATA).collect()}
    gone = {r["doc_id"] for r in docs.collect()} - kept
    assert gone == expected and {5001, 5002} <= gone
    assert sum(r["doc_id"] in gone for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()) == 0


def test_unsure_languages_stay(spark, monkeypatch):
    def unsure(docs):
        return docs.selectExpr("*", "if(doc_id = 3, 'und', 'en') AS lang_pred", "if(doc_id = 3, 1.0D, 0.3D) AS score")

    monkeypatch.setattr(P.lang_cnn, "predict_languages", unsure)
    docs = spark.createDataFrame([(i, "some words", "en", "src0", 10, "s", 1) for i in range(5)], SCHEMA)
    kept = P.keep_known_languages(spark, docs, DATA).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 4]
