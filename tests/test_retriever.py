"""The whole way from XML files to answers."""

from tests.test_article_xml import record, title, write
from vectrail import Retriever, build_articles, build_codes, build_vectors
from vectrail.operators.embedding import hashing_model

TEXTS = {
    1: "Glucagon receptors in the brain control body weight",
    2: "Hippo signalling and organ growth in flies",
    3: "Bariatric surgery and weight loss in adults",
    4: "Deep sea bacteria of hydrothermal vents",
}


def test_from_xml_to_answers(spark, tmp_path):
    for doc, text in TEXTS.items():
        body = f"<Abstract><AbstractText>{text}</AbstractText></Abstract>"
        write(tmp_path / "xml", f"n{doc}.xml.gz", record(str(doc), title(f"Title {doc}"), body))
    model = hashing_model(256)
    articles = build_articles(spark, str(tmp_path / "xml"), str(tmp_path / "articles"))
    vectors = build_vectors(articles, model, str(tmp_path / "vectors"), prefix="")
    codes = build_codes(vectors, str(tmp_path / "codes"), str(tmp_path / "range"))

    retriever = Retriever(vectors, articles, model)
    rows = retriever.search("weight loss in adults", k=2).collect()
    assert [(r["rank"], r["doc_id"], r["title"]) for r in rows][0] == (1, 3, "Title 3")
    assert rows[0]["similarity"] > rows[1]["similarity"] and rows[0]["publication_year"] == 2001
    assert retriever.search(TEXTS[4], k=4, num_records=3).count() == 3

    queries = spark.createDataFrame([(10 + d, t) for d, t in TEXTS.items()], "query_id bigint, text string")
    best = retriever.search_many(queries, k=1).collect()
    assert [(r["query_id"], r["doc_id"]) for r in best] == [(11, 1), (12, 2), (13, 3), (14, 4)]
    assert all(abs(r["similarity"] - 1) < 1e-6 for r in best)

    # Codes carry an offset, so scores differ, but the results have the same form.
    found = Retriever(codes, articles, model).search(TEXTS[2], k=4).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 4]

    dotted = Retriever(vectors, articles, model, metric="dot", query_prefix="search_query: ")
    assert dotted.search(TEXTS[1], k=1).head()["doc_id"] == 1
