"""Column functions over article fields."""

from pyspark.sql import functions as F

from vectrail.functions import text as X


def test_blank_abstracts_fall_back_to_the_title(spark):
    blanks = [None, "", "  \t\n", " ", " 　", "\x1c\x85 ", " x ", "​"]
    df = spark.createDataFrame([(i, "t", b) for i, b in enumerate(blanks)], "i int, title string, abstract string")
    chosen = df.select("i", X.embedding_text(F.col("title"), F.col("abstract"))).collect()
    for i, text in chosen:
        blank = blanks[i] is None or blanks[i].strip() == ""
        assert text == ("t" if blank else blanks[i])


def test_publication_year(spark):
    cases = [
        ("2001", None, "2001", 2001),
        ("", "1998 Dec-1999 Jan", "1998", 1998),
        (None, "Spring 1998", "Spri", None),
        (None, "98", "98", 98),
        (None, None, None, None),
        ("2001", "1998", "2001", 2001),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, y string, d string")
    y, d = F.col("y"), F.col("d")
    rows = df.select("i", X.publication_year_raw(y, d), X.publication_year(y, d)).collect()
    assert all((r[1], r[2]) == cases[r[0]][2:] for r in rows)


def test_author_list(spark):
    kind = "i int, a array<struct<fore_name:string,last_name:string>>"
    df = spark.createDataFrame(
        [
            (0, [("Ann", "Lee"), (None, "The Group"), ("", "Roe"), ("Bo", "Orr")]),
            (1, [(None, "The Group")]),
            (2, []),
            (3, None),
        ],
        kind,
    )
    rows = dict(df.select("i", X.author_list(F.col("a"))).collect())
    assert rows == {0: "Ann Lee, Bo Orr", 1: "", 2: "", 3: ""}


def test_valid_articles(spark):
    cases = [("1", "t", None), ("1", "", ""), ("", "t", "a"), (None, "t", "a"), ("1", None, "a"), ("1", None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, t string, a string")
    kept = df.where(X.is_valid_article(F.col("p"), F.col("t"), F.col("a"))).collect()
    assert sorted(r[0] for r in kept) == [0, 4]


def test_truncation(spark):
    df = spark.createDataFrame([("  a b\n c\td ",)], "s string")
    assert df.select(X.truncate_tokens(F.col("s"), 3)).head()[0] == "a b c"
    assert df.select(X.truncate_tokens(F.col("s"), 9)).head()[0] == "a b c d"
