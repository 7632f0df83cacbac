"""The pipeline against its operators' brute-force versions, stage by stage."""

from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_best_fit import PATH, brute
from tests.llm.test_pipeline_near_copies import roots
from tests.llm.test_suffix_dedup import brute as cut
from vectrail.llm import best_fit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _row long"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "'s' AS score", "1L AS _row")
    more = [(5001, None, None, None, None, "s", 1), (5002, "123 456", "en", "src0", 7, "s", 1)]
    more += [(5003, "the and of that with the thing is here", None, None, 38, "s", 1)] * 2
    more += [(None, "the and of that with no id is here", "en", "src0", 34, "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    held = [docs.collect()]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DATA).write.parquet(path)
        out = spark.read.parquet(path)
        if name != P.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names
        docs = out
        held.append(out.collect())
    return held


def test_only_texts_without_a_language_go(stages):
    before, after = Counter(stages[0]), Counter(stages[1])
    assert not after - before
    gone = {r["doc_id"] for r in (before - after)}
    assert {5001, 5002} <= gone and len(gone) <= 6


def test_one_document_of_each_class_stays(stages):
    rows = [r for r in stages[1] if r["doc_id"] is not None]
    # Five words at 80 percent; no two texts of these rows share an id.
    firsts = roots(sorted({(r["doc_id"], r["text"]) for r in rows}))
    assert sorted(r["doc_id"] for r in stages[2] if r["doc_id"] is not None) == sorted(firsts)
    assert sum(r["doc_id"] is None for r in stages[2]) == 1


def test_repeated_passages_go(stages):
    expected = Counter((i, kept.decode("utf-8", "ignore")) for i, *_, kept in cut([(r["doc_id"], r["text"]) for r in stages[2]]))
    assert Counter((r["doc_id"], r["text"]) for r in stages[3]) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_sources_are_mixed(stages):
    before, after = Counter(stages[3]), Counter(stages[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    words = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert abs(words(stages[4]) - words(stages[3])) <= 0.1 * words(stages[3])


def test_all_that_is_left_is_packed(stages):
    expected = Counter((r["doc_id"], *p) for r in stages[4] for p in brute(r["text"], 4096))
    found = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[5])
    assert found == expected
    ends = Counter()
    for r in stages[5]:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096


def test_run_is_the_registered_pipeline(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is P.run and PATH and best_fit


def through(spark, rows, columns):
    docs = spark.createDataFrame(rows, columns)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
    return P.STAGES[-1][1](spark, docs, DATA)


def test_no_documents(spark):
    assert through(spark, [], "doc_id long, text string, lang string, source string, n_chars long").count() == 0


def test_no_labels_no_lengths_and_one_long_text(spark):
    # No language is known, so only the text without letters goes; n_chars is not among the columns.
    long = " ".join(f"word{i * i}" for i in range(150_000))
    rows = [(1, long, None, "a"), (2, "Some words of a short text.", None, "a"), (3, "12 34", None, "b"), (4, None, None, "b")]
    rows += [(5, long + " and one more", None, "b")]
    packed = through(spark, rows, "doc_id long, text string, lang string, source string")
    # The near copy of the long text is gone too.
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= {1, 2}
    assert packed.where("doc_id = 1").count() > 100
