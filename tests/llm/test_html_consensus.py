"""Main text of pages of many layouts, and the votes of hosts."""

import random

import pytest

from vectrail.llm.html_consensus import Page, extract_pages, host_paths

SCHEMA = "page_id long, url string, html string, host string, keys string, text string"


def alone(html):
    return Page(html).extract([])


BODY = "<p>First line of the story.</p><p>Second <b>line</b> &amp; more&nbsp;text.</p>"
TEXT = "First line of the story.\nSecond line & more text."
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of today</a></li></ul></nav>"

LAYOUTS = {
    "article": f"<html><body>{MENU}<article><h1>Title</h1>{BODY}</article><footer>&copy; me</footer></body></html>",
    "main": f"<body>{MENU}<main><h1>Title</h1>{BODY}</main><aside><p>Read also this.</p></aside></body>",
    "div": f"<body><div class='menu'><a href=1>One</a></div><div class='post-77 entry'><h1>Title</h1>{BODY}</div><div id=comments><p>I think otherwise!</p></div></body>",
    "comment articles": f"<body><main><article><h1>Title</h1>{BODY}</article><ol class='commentlist'><li><article class='comment-body'><p>Nonsense, all of it, as I have always said and will say.</p></article></ol></main></body>",
    "page form": f"<form id=aspnetForm><div class=header>Site</div><article><h1>Title</h1>{BODY}</article><input value=x><button>Go</button></form>",
    "wrapper": f"<body class='has-sidebar'><div class='with-sidebar'><div class=content><h1>Title</h1>{BODY}</div></div><div class=sidebar><p>Links</p></div></body>",
    "own header": f"<article><header><h1>Title</h1><span class=by>By me</span></header>{BODY}<footer>Filed under x</footer></article>",
    "inside": f"<article><h1>Title</h1><div class='ad'>Buy!</div><form><label>Mail</label><input></form><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> -->{BODY}<div class='cookie-notice'>We use cookies.</div><div hidden>unseen</div></article>",
    "unclosed": "<article><h1>Title<p>First line\n of  the <i>story.<p>Second <b>line &amp more&#160;text.</article><footer>x",
    "upper case": f"<BODY><NAV>x</NAV><ARTICLE><H1>Title</H1>{BODY.replace('p>', 'P>')}</ARTICLE></BODY>",
    "sections": f"<body>{MENU}<div class=page><div class=s1><h1>Title</h1><p>First line of the story.</p></div><div class=s2><p>Second line &amp; more text.</p></div></div><footer>f</footer></body>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    assert alone(LAYOUTS[name]) == "Title\n" + TEXT


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("   \n ", ""),
        ("plain words", "plain words"),
        ("<nav>menu</nav><footer>end</footer>", ""),
        ("<script>alert('a')", ""),
        ("<!-- never closed <p>a</p>", ""),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<p>1&lt;2 &#233; &#x41; &bogus; &am</p>", "1<2 é A &bogus; &am"),
        ("<p>a<br>b</p><ul><li>one<li>two</ul>", "a b\none\ntwo"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<p title='a > b'>x</p><p title=\"it's\">y</p>", "x\ny"),
        ("<p>in<b>ter</b>rupted <span class=ad>Buy</span>word", "interrupted word"),
        ("</p></div></article>text", "text"),
        ("<a href='x'", "<a href='x'"),
    ],
)
def test_fragments(html, text):
    assert alone(html) == text


def test_any_bytes_are_read_without_error():
    draw = random.Random(4)
    parts = ["<p>", "</p>", "<div class=", '"', "'", ">", "<", "<!--", "-->", "&amp", "</", "<td", "<li>", "text ", "<a href=x>", "<script>", "</script>", "<article>", "\x00", "é"]
    for _ in range(500):
        Page("".join(draw.choices(parts, k=30))).extract([])


def test_deep_and_long_pages():
    assert alone("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert alone("<article>" + "<p>line</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert alone("<article><p>" + "x " * 1_000_000 + "</p></article>") == "x " * 999_999 + "x"


def sparse(host, n, odd):
    """Pages of one layout, of which one has more beside its story than in it."""
    story = "<div class='story-{0}'><p>Story {0} is told in these words, of which there are some.</p></div>"
    side = "<div class='x'><p>{}</p></div>"
    pages = [(i, f"https://{host}/{i}", f"<body>{story.format(i)}{side.format('Short.')}</body>") for i in range(n)]
    return [*pages, (odd, f"https://{host}/odd", f"<body>{story.format(odd)}{side.format('Beside ' * 11)}</body>")]


def test_the_host_outvotes_a_page(spark):
    rows = sparse("a.example", 20, 99)
    odd = rows[-1][2]
    assert "Beside" in alone(odd)
    rows += [(200, "https://b.example/x", odd), (201, None, LAYOUTS["div"]), (202, "no url", None), (99, "https://A.example:80/again", odd)]
    df = spark.createDataFrame([(*r, "h", "k", "t") for r in rows], SCHEMA).repartition(4)
    found = extract_pages(df).collect()
    assert len(found) == len(rows)
    texts = {(r["page_id"], r["url"]): r["text"] for r in found}
    told = "Story 99 is told in these words, of which there are some."
    assert texts[99, "https://a.example/odd"] == texts[99, "https://A.example:80/again"] == told
    assert "Beside" in texts[200, "https://b.example/x"]
    assert texts[201, None] == "Title\n" + TEXT and texts[202, "no url"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    votes = {(r["host"], r["path"]): r["votes"] for r in host_paths(df).collect()}
    assert votes["a.example", "body/div.story-#"] == 20


def test_no_pages_and_large_ids(spark):
    assert extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [((1 << 60) + 1, "u", "<p>x</p>", "", "", ""), (None, "u", "<p>y</p>", "", "", "")]
    found = extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["page_id"], r["text"]) for r in found} == {((1 << 60) + 1, "x"), (None, "y")}
