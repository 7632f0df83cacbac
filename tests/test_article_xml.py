"""Hand-made XML files: field rules, file selection, splitting, incremental runs."""

import gzip
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectrail.plans.build import build_articles
from vectrail.plans.catalog.standins import write_xml
from vectrail.schema import ARTICLE_COLUMNS, SOURCE_ORDER
from vectrail.sources import article_xml
from vectrail.sources.article_xml import bad_records, read_articles, read_records, source_files
from vectrail.streaming import incremental
from vectrail.streaming.incremental import ingest_new_files, read_ingested

HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<PubmedArticleSet>\n'
TAIL = "</PubmedArticleSet>\n"

AUTHORS = (
    "<AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author>"
    "<Author><CollectiveName>The Group</CollectiveName></Author>"
    "<Author><LastName>Păd</LastName><ForeName>Bo</ForeName></Author></AuthorList>"
)


def record(pmid, title="", abstract="", date="<Year>2001</Year>", authors="", more=""):
    return (
        f"<PubmedArticle>\n<MedlineCitation><PMID Version='1'>{pmid}</PMID><Article><Journal><PubDate>"
        f"{date}</PubDate></Journal>{title}{abstract}{authors}</Article>{more}</MedlineCitation></PubmedArticle>\n"
    )


def title(text):
    return f"<ArticleTitle>{text}</ArticleTitle>"


def write(folder: Path, name: str, *records: str) -> None:
    folder.mkdir(exist_ok=True)
    content = (HEAD + "".join(records) + TAIL).encode()
    (folder / name).write_bytes(gzip.compress(content) if name.endswith(".gz") else content)


RECORDS = [
    record("1", title("Role of <i>ABC1</i> in cells"), authors=AUTHORS),
    record("2", title("<i>ABC1</i> first"), "<Abstract><AbstractText>Kept.</AbstractText></Abstract>"),
    record("3", title("<i>only markup</i>")),
    record("4", title("p &lt; 0.05 &amp; more"), "<AbstractText Label='A'>One</AbstractText><AbstractText>Two</AbstractText>"),
    record("5", title("long date"), date="<MedlineDate>1998 Dec-1999 Jan</MedlineDate>"),
    record("6", title("short date"), date="<MedlineDate>98</MedlineDate>"),
    record("7", title("word date"), date="<MedlineDate>Spring</MedlineDate>"),
    record("8", title("no date"), date=""),
    record("9", title("nested"), more="<CommentsCorrections><PMID>77</PMID></CommentsCorrections>"),
    record("", title("no id")),
    record("10"),
    record("x11", title("a <!-- comment --> b<![CDATA[ <c> ]]>")),
    "<PubmedBookArticle><PMID>99</PMID><ArticleTitle>book</ArticleTitle></PubmedBookArticle>\n",
    record("12", title("last"), date="<Year></Year><MedlineDate>2003 Jan</MedlineDate>"),
]

# pmid, title, authors, abstract, year, raw year
EXPECTED = [
    ("1", "Role of ", "Ann Lee, Bo Păd", None, 2001, "2001"),
    ("2", "", "", "Kept.", 2001, "2001"),
    ("4", "p < 0.05 & more", "", "One", 2001, "2001"),
    ("5", "long date", "", None, 1998, "1998"),
    ("6", "short date", "", None, 98, "98"),
    ("7", "word date", "", None, None, "Spri"),
    ("8", "no date", "", None, None, None),
    ("9", "nested", "", None, 2001, "2001"),
    ("x11", "a  b <c> ", "", None, 2001, "2001"),
    ("12", "last", "", None, 2003, "2003"),
]

FIELDS = ["pmid", "title", "authors", "abstract", "publication_year", "publication_year_raw"]


@pytest.mark.parametrize("name", ["a.xml", "a.xml.gz"])
@pytest.mark.parametrize("rebalance", [False, True])
def test_fields(spark, tmp_path, name, rebalance):
    write(tmp_path / "in", name, *RECORDS)
    found = read_articles(spark, str(tmp_path / "in"), rebalance=rebalance)
    rows = found.orderBy(*SOURCE_ORDER).select(*FIELDS).collect()
    assert [tuple(r) for r in rows] == EXPECTED
    ids = {r["pmid"]: r["doc_id"] for r in found.collect()}
    assert ids["12"] == 12 and ids["x11"] is None


def test_files_are_split_at_records(spark, tmp_path):
    records = [record(str(i), title(f"title {i} " + "x" * (i % 700))) for i in range(3000)]
    write(tmp_path / "in", "big.xml", *records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        articles = read_articles(spark, str(tmp_path / "in"))
        assert articles.rdd.getNumPartitions() > 4
        rows = articles.orderBy(*SOURCE_ORDER).select("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in rows] == list(range(3000))


def test_only_xml_files_are_read(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.xml", record("1", title("a")))
    write(folder, "b.xml.gz", record("2", title("b")))
    for other in ("c.txt", "d.xml.md5", "e.xml.gz.tmp"):
        write(folder, other, record("3", title("c")))
    assert sorted(r[0] for r in read_articles(spark, str(folder)).select("pmid").collect()) == ["1", "2"]
    assert sorted(r[0] for r in source_files(spark, str(folder)).collect()) == ["a.xml", "b.xml.gz"]


def test_first_copy_wins_across_files(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "n2.xml.gz", record("1", title("later file")), record("3", title("three")))
    write(folder, "n1.xml.gz", record("1", title("first")), record("1", title("later row")), record("2", title("two")))
    articles = build_articles(spark, str(folder), str(tmp_path / "table"))
    assert {r["pmid"]: r["title"] for r in articles.collect()} == {"1": "first", "2": "two", "3": "three"}


def test_broken_record_fails(spark, tmp_path):
    write(tmp_path / "in", "a.xml", "<PubmedArticle><PMID>1</PubmedArticle>")
    with pytest.raises(Exception, match="mismatched tag"):
        read_articles(spark, str(tmp_path / "in")).collect()


def test_incremental_runs(spark, tmp_path):
    source, table, ledger = (tmp_path / n for n in ("in", "table", "ledger"))
    write(source, "n1.xml.gz", record("1", title("first")), record("1", title("again")))
    write(source, "n2.xml.gz", record("2", title("two")), record("1", title("other file")))

    def run(**options):
        ingest_new_files(spark, str(source), str(table), str(ledger), **options)
        return {r["pmid"]: r["title"] for r in read_ingested(spark, str(table)).collect()}

    assert run() == {"1": "first", "2": "two"}
    batches = sorted(p.name for p in table.glob("ledger=*/batch_id=*"))
    assert run() == {"1": "first", "2": "two"} and batches
    assert sorted(p.name for p in table.glob("ledger=*/batch_id=*")) == batches
    write(source, "n3.xml", record("2", title("changed")), record("3", title("three")))
    assert run(max_files_per_batch=1) == {"1": "first", "2": "two", "3": "three"}


def test_two_ledgers_of_one_table_lose_and_change_nothing(spark, tmp_path):
    table = str(tmp_path / "table")
    write(tmp_path / "a", "n1.xml", record("1", title("one")), record("2", title("two")))
    write(tmp_path / "b", "n1.xml", record("3", title("three")), record("2", title("two again")))

    def run(source, ledger):
        ingest_new_files(spark, str(tmp_path / source), table, str(tmp_path / ledger))
        rows = read_ingested(spark, table).select("pmid", "title").orderBy("pmid").collect()
        return [tuple(r) for r in rows]

    assert run("a", "ledger-a") == [("1", "one"), ("2", "two")]
    stored = [("1", "one"), ("2", "two"), ("3", "three")]
    assert run("b", "ledger-b") == stored
    write(tmp_path / "a", "n2.xml", record("3", title("three again")))
    assert run("a", "ledger-a") == stored
    # A lost ledger reads all files anew and finds everything stored.
    assert run("a", "new-ledger-a") == stored


def test_repeated_batch_replaces_its_own_rows(spark, tmp_path):
    source, table, ledger = tmp_path / "in", tmp_path / "table", tmp_path / "ledger"
    write(source, "n1.xml", record("1", title("one")), record("2", title("two")))
    ingest_new_files(spark, str(source), str(table), str(ledger))
    # The batch ran, but its commit was lost.
    for commit in [p for p in (ledger / "commits").iterdir() if "0" in p.name]:
        commit.unlink()
    ingest_new_files(spark, str(source), str(table), str(ledger))
    rows = read_ingested(spark, str(table)).select("pmid").orderBy("pmid").collect()
    assert [r[0] for r in rows] == ["1", "2"]
    assert len(list(table.glob("ledger=*/batch_id=*"))) == 1


def test_sources_can_be_deleted(spark, tmp_path):
    source = tmp_path / "in"
    for n in (1, 2, 3):
        write(source, f"n{n}.xml", record(str(n), title("t")))
        ingest_new_files(
            spark, str(source), str(tmp_path / "table"), str(tmp_path / "ledger"), clean_source="delete"
        )
    assert read_ingested(spark, str(tmp_path / "table")).count() == 3
    assert len(list(source.rglob("*.xml"))) < 3


def test_records_are_parsed_once(spark, tmp_path, capsys):
    write(tmp_path / "in", "a.xml", record("1", title("t")))
    read_articles(spark, str(tmp_path / "in")).explain()
    plan = capsys.readouterr().out
    assert plan.count("_parse(") == 1


def test_namespaces_and_entities_of_the_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xml").write_text(
        '<!DOCTYPE x [<!ENTITY drug "a &lt; b">]><Set xmlns:m="urn:math">'
        "<PubmedArticle><PMID>1</PMID><ArticleTitle>&drug; &eacute; &amp;<m:b/>x</ArticleTitle></PubmedArticle>"
        '<PubmedArticle><PMID m:k="v">2</PMID><ArticleTitle>&nbsp;&alpha;</ArticleTitle></PubmedArticle></Set>'
    )
    rows = read_articles(spark, str(folder)).orderBy("pmid").collect()
    assert [(r["pmid"], r["title"]) for r in rows] == [("1", "a < b é &"), ("2", "\xa0α")]


def test_bad_records_are_set_aside(spark, tmp_path):
    write(tmp_path / "in", "a.xml", record("1", title("t")), "<PubmedArticle><PMID>2</PubmedArticle>")
    path = str(tmp_path / "in")
    assert [r["pmid"] for r in read_articles(spark, path, on_bad_record="skip").collect()] == ["1"]
    bad = bad_records(read_records(spark, path)).collect()
    assert len(bad) == 1 and "mismatched" in bad[0]["error"] and "<PMID>2" in bad[0]["value"]


def test_sources_can_be_archived(spark, tmp_path):
    source, archive = tmp_path / "in", tmp_path / "archive"
    for n in (1, 2, 3):
        write(source, f"n{n}.xml", record(str(n), title("t")))
        ingest_new_files(
            spark, str(source), str(tmp_path / "table"), str(tmp_path / "ledger"),
            clean_source="archive", archive=str(archive),
        )
    assert read_ingested(spark, str(tmp_path / "table")).agg(F.count("*")).head()[0] == 3
    assert list(archive.rglob("*.xml"))


def test_whole_texts_with_markup_and_sections(spark, tmp_path):
    sections = (
        "<Abstract><AbstractText Label='AIMS' NlmCategory='OBJECTIVE'>To <b>test</b> H<sub>2</sub>O.</AbstractText>"
        "<AbstractText Label=''>Plain\n  section.</AbstractText><AbstractText Label='NONE'> </AbstractText>"
        "<AbstractText Label='END'><i>p</i> &lt; 0.05 &amp; more.</AbstractText></Abstract>"
        "<OtherAbstract><AbstractText>Anderes.</AbstractText></OtherAbstract>"
    )
    records = [
        record("1", title("Role of <i>ABC<sup>1</sup></i> in cells <!-- c -->now"), sections),
        record("2", title("<i>only markup</i>")),
        record("3", title("bare"), "<AbstractText>One</AbstractText><AbstractText>Two</AbstractText>"),
        record("4", title(" "), "<Abstract><AbstractText> </AbstractText></Abstract>"),
    ]
    write(tmp_path / "x", "a.xml", *records)
    full = {r["pmid"]: (r["title"], r["abstract"]) for r in read_articles(spark, str(tmp_path / "x"), text_mode="full").collect()}
    assert full == {
        "1": ("Role of ABC1 in cells now", "AIMS: To test H2O.\nPlain section.\nEND: p < 0.05 & more."),
        "2": ("only markup", None),
        "3": ("bare", "One\nTwo"),
    }
    leading = {r["pmid"]: (r["title"], r["abstract"]) for r in read_articles(spark, str(tmp_path / "x")).collect()}
    assert leading["1"] == ("Role of ", "To ") and "2" not in leading
    with pytest.raises(ValueError, match="text_mode"):
        read_articles(spark, str(tmp_path / "x"), text_mode="some")


def test_records_are_parsed_in_pieces_of_few_bytes():
    sizes = [100] * 50_000 + [5 << 20, 0, 100, 2 << 20]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes]), pa.array(range(len(sizes)))], names=["record", "row"])
    pieces = list(article_xml._pieces(batch))
    assert [i for p in pieces for i in p.column(1).to_pylist()] == list(range(len(sizes)))
    held = [sum(len(r) for r in p.column(0).to_pylist()) for p in pieces]
    assert all(p.num_rows == 1 or n <= article_xml.PARSED_BYTES for p, n in zip(pieces, held))
    assert len(pieces) <= 10 and all(p.num_rows for p in pieces)
    assert not list(article_xml._pieces(batch.slice(0, 0)))


def test_a_batch_adds_the_first_copy_of_new_ids_from_any_task(spark, tmp_path):
    """Words of 64 rows, several tasks and files; some ids stored, some twice, some records without text."""
    source, table, ledger = (str(tmp_path / n) for n in ("in", "table", "ledger"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 10))
    try:
        write(tmp_path / "in", "n1.xml", *(record(str(i), title("stored")) for i in range(0, 900, 3)))
        ingest_new_files(spark, source, table, ledger)
        for name in ("n2.xml", "n3.xml.gz"):
            write(tmp_path / "in", name, *(record(f"{i % 700}", title(f"{name} {i}") if i % 5 else "") for i in range(1500)))
        ingest_new_files(spark, source, table, ledger)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = {str(i): "stored" for i in range(0, 900, 3)}
    for name in ("n2.xml", "n3.xml.gz"):
        for i in range(1500):
            if i % 5:
                wanted.setdefault(str(i % 700), f"{name} {i}")
    rows = [(r["pmid"], r["title"]) for r in read_ingested(spark, table).collect()]
    assert len(rows) == len(wanted) and dict(rows) == wanted


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_texts_of_rows_to_add_stay_where_they_are(spark, monkeypatch, sent):
    monkeypatch.setattr(incremental, "SENT_WORDS", sent)
    batch = spark.range(0, 1000, 1, 3).selectExpr("string(id) AS pmid", "id AS doc_id", "monotonically_increasing_id() AS source_row")
    # Rows at both ends of a word, too.
    marks = incremental._marks(batch.where("source_row % 64 in (0, 63) or doc_id % 7 = 0"))
    added = incremental._rows_at(batch, marks, marks.count())
    wanted = batch.where("source_row % 64 in (0, 63) or doc_id % 7 = 0")
    assert sorted(added.collect()) == sorted(wanted.collect())
    assert not sent or "BroadcastHashJoin" in added._jdf.queryExecution().sparkPlan().toString()


def test_an_ingest_shuffles_no_text(spark, tmp_path, monkeypatch):
    plans = []
    done = incremental.write_articles

    def written(articles, *args, **kwargs):
        plans.append(articles.select(*ARTICLE_COLUMNS)._jdf.queryExecution().sparkPlan().toString())
        done(articles, *args, **kwargs)

    monkeypatch.setattr(incremental, "write_articles", written)
    write(tmp_path / "in", "n1.xml", *(record(str(i), title("t")) for i in range(100)))
    source, table, ledger = (str(tmp_path / n) for n in ("in", "table", "ledger"))
    ingest_new_files(spark, source, table, ledger)
    # Few new ids among stored ones are packed.
    write(tmp_path / "in", "n2.xml", *(record(str(i), title("t")) for i in range(110)))
    ingest_new_files(spark, source, table, ledger)
    outside = [p.split("InMemoryRelation")[0] for p in plans]
    assert all("BroadcastHashJoin" in p and "Window" not in p for p in outside)
    assert ["REBALANCE" in p for p in outside] == [False, True]
    assert read_ingested(spark, table).count() == 110


def test_xml_is_written_where_its_rows_are(spark, tmp_path):
    fields = spark.range(0, 40, 1, 4).selectExpr(
        "string(id) AS pmid", "'t' AS title", "'a' AS abstract", "'2000' AS year", "string(NULL) AS medline_date",
        "array(named_struct('fore_name', 'f', 'last_name', 'l')) AS authors",
    )
    write_xml(fields, str(tmp_path / "x"))
    assert len(list((tmp_path / "x").glob("*.xml"))) == 4
    assert read_articles(spark, str(tmp_path / "x")).count() == 40
