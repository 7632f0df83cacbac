"""Main text of web pages by consensus of the pages of a host.

Each page scores its containers and votes for the generalised tag-class path of its best one. Spark
adds the votes of a host, and a second pass takes from each page the container that stands at the
path with most votes there. A page without any of its host's paths falls back on its own best.
"""

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.scratch import written

#: How many paths of a host its pages may use, those with most votes first.
PATHS = 8
#: A host's path is taken where its text scores at least this share of the page's best container.
AGREES = 0.5

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr td th".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An element on the left ends open ones on the right that lie inside the nearest of the last list.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
CONTAINERS = frozenset("html body div section article main center td table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, roles and class words of what is not the article.
OUTSIDE_TAGS = frozenset(
    "head script style noscript template svg iframe object embed audio video canvas button input "
    "select textarea fieldset datalist nav aside footer menu dialog title".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion nav "
    "navbar navigation menu menubar breadcrumb breadcrumbs pager pagination footer masthead topbar "
    "sidebar widget widgets related recommended share sharing social cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus respond replies form hidden copyright".split()
)
CONTENT_WORDS = frozenset("article post entry content story text main body".split())

_TOKEN = re.compile(
    r"<!--(?>.*?-->|.*)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Page:
    """The elements of a page in order and its pieces of text.

    An element is a row of parallel lists; its descendants are the elements up to its ``end``. A
    piece is ``(block, element, text, is a link)``; pieces of one block make one line.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.end, self.step = ["#root"], [-1], [0], [b""]
        self.words, self.outside, self.pieces = [frozenset()], [""], []
        self._read(html)
        self.end[0] = len(self.tag) - 1
        self._mark()
        self._weigh()

    def _read(self, html: str) -> None:
        tags, parents, ends = self.tag, self.parent, self.end
        stack, open_tags, block, link, at = [0], {}, 0, False, 0

        def close(upto: int) -> None:
            nonlocal link
            while len(stack) > upto:
                node = stack.pop()
                ends[node] = len(tags) - 1
                open_tags[tags[node]] -= 1
                if tags[node] not in INLINE:
                    link = False

        def last_open(wanted, inside) -> int:
            for depth in range(len(stack) - 1, 0, -1):
                tag = tags[stack[depth]]
                if tag in wanted:
                    return depth
                if tag in inside:
                    return 0
            return 0

        size = len(html)
        while at < size:
            found = _TOKEN.search(html, at)
            upto = found.start() if found else size
            if upto > at:
                self.pieces.append((block, stack[-1], unescape(html[at:upto]), link))
            if not found:
                break
            at = found.end()
            tag = found["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if found["end"]:
                if tag == "a":
                    link = False
                if tag not in INLINE:
                    block += 1
                elif tag in ("td", "th"):
                    self.pieces.append((block, stack[-1], " ", link))
                if open_tags.get(tag):
                    # A mark for letters ends nothing beyond its own block.
                    depth = last_open((tag,), CLOSES_P | CONTAINERS if tag in INLINE else ())
                    if depth:
                        close(depth)
                continue
            if tag in CLOSES_P and open_tags.get("p"):
                depth = last_open(("p",), CONTAINERS | {"li", "blockquote"})
                if depth:
                    close(depth)
            if tag in SIBLINGS:
                same, inside = SIBLINGS[tag]
                depth = 1
                while depth and any(open_tags.get(t) for t in same):
                    depth = last_open(same, inside)
                    if depth:
                        close(depth)
            if tag not in INLINE:
                block += 1
            elif tag in ("br", "td", "th"):
                self.pieces.append((block, stack[-1], " ", link))
            if tag == "a":
                link = True
            attrs = found["attrs"]
            if tag in VOID:
                continue
            if tag in INLINE and tag not in ("td", "th") and (len(attrs) < 5 or tag == "a" and "class" not in attrs):
                continue
            node = len(tags)
            tags.append(tag)
            parents.append(stack[-1])
            ends.append(node)
            self._describe(tag, attrs)
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = closing.start() if closing else size
        close(1)

    def _describe(self, tag: str, attrs: str) -> None:
        """What an element's attributes say: its step in a path and why it may not be article."""
        names, words, why = [], set(), ""
        if len(attrs) > 4:
            for name, *values in _ATTRIBUTE.findall(attrs):
                name, value = name.lower(), unescape("".join(values))
                if name in ("class", "id"):
                    words.update(w.lower() for w in _WORD.findall(value))
                    if name == "class":
                        names = sorted({_DIGITS.sub("#", n.lower()) for n in value.split()})
                elif name == "role" and value.lower() in OUTSIDE_ROLES:
                    why = "tag"
                elif name == "role" and value.lower() == "main" or value == "articleBody":
                    words.add("#article")
                elif name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
                    why = "tag"
            if re.search(r"\shidden(?=[\s/>])", _ATTRIBUTE.sub(" ", attrs)):
                why = "tag"
        if tag in OUTSIDE_TAGS:
            why = "tag"
        elif tag == "header" or "header" in words:
            why = why or "header"
        elif tag not in ("html", "body") and (tag == "form" or words & OUTSIDE_WORDS):
            why = why or "word"
        self.words.append(frozenset(words))
        self.outside.append(why)
        self.step.append((tag + "".join("." + n for n in names)).encode())

    def _is_article(self, node: int) -> bool:
        named = self.tag[node] in ("article", "main") or "#article" in self.words[node]
        return named and self.outside[node] != "word"

    def _mark(self) -> None:
        """Which elements are outside of any article, and the key of each one's path."""
        n = len(self.tag)
        holds, titled, inside, size = [False] * n, [False] * n, [False] * n, [0] * n
        for _, node, text, _ in self.pieces:
            size[node] += len(text) if self.outside[node] != "tag" else 0
        for node in range(n - 1, 0, -1):
            parent = self.parent[node]
            holds[parent] |= holds[node] or self._is_article(node)
            titled[parent] |= titled[node] or self.tag[node] == "h1"
            size[parent] += size[node] if self.outside[parent] != "tag" else 0
        # Words in the classes of a wrapper speak of its parts: it has the title and most of the text.
        for node in range(1, n):
            holds[node] |= titled[node] and 2 * size[node] > size[0]
        self.dropped, self.title, self.key = [False] * n, [False] * n, [b""] * n
        headed = [False] * n
        for node in range(1, n):
            parent, why = self.parent[node], self.outside[node]
            inside[node] = inside[parent] or self._is_article(node)
            # An article's own header gives its headings; a hint by words fails if an article is within.
            own = headed[parent] or (why == "header" and inside[node])
            self.title[node] = self.title[parent] or self.tag[node] in HEADINGS
            headed[node] = own
            out = why == "tag" or why == "word" and not holds[node] or why == "header" and not (inside[node] or holds[node])
            self.dropped[node] = self.dropped[parent] or out
            self.key[node] = blake2b(self.key[parent] + self.step[node], digest_size=16).digest()
        for node in range(n):
            if headed[node] and not self.title[node]:
                self.dropped[node] = True

    def _weigh(self) -> None:
        """Letters of text and of all else below every element."""
        n = len(self.tag)
        self.good, self.noise = [0.0] * n, [0.0] * n
        for _, node, text, link in self.pieces:
            size = len(text) - text.count(" ")
            if self.dropped[node]:
                self.noise[node] += size
            else:
                # A link may stand in the article too, but lists of links are menus.
                self.good[node] += size * (0.25 if link else 1)
                self.noise[node] += size * (0.75 if link else 0)
        for node in range(n - 1, 0, -1):
            self.good[self.parent[node]] += self.good[node]
            self.noise[self.parent[node]] += self.noise[node]

    def score(self, node: int) -> float:
        """Share of the page's text less half the share of its other letters, and what tags say."""
        if not self.good[node] or self.dropped[node]:
            return 0.0
        value = self.good[node] / self.good[0]
        if self.noise[0]:
            value -= 0.5 * self.noise[node] / self.noise[0]
        if self._is_article(node):
            return value + 0.3
        if self.tag[node] in ("html", "body", "#root"):
            return value - 0.1
        return value + (0.15 if self.words[node] & CONTENT_WORDS else 0)

    def best(self) -> int | None:
        """The container of highest score, the innermost and first of equal ones; None without text."""
        if not self.good[0]:
            return None
        depth, found, top = [0] * len(self.tag), None, ()
        for node, tag in enumerate(self.tag):
            if node:
                depth[node] = depth[self.parent[node]] + 1
            if tag in CONTAINERS or tag == "#root" or "-" in tag:
                rank = (self.score(node), depth[node])
                if self.good[node] and not self.dropped[node] and (found is None or rank > top):
                    found, top = node, rank
        return found

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.step[node].decode())
            node = self.parent[node]
        return "/".join(reversed(steps))

    def at(self, key: bytes) -> list[int]:
        return [node for node, own in enumerate(self.key) if own == key and not self.dropped[node]]

    def text(self, nodes: list[int]) -> str:
        """The lines below some elements in page order, each with single spaces."""
        lines, last, parts = [], None, []
        spans = sorted((node, self.end[node]) for node in nodes)
        at = 0
        for block, node, text, _ in self.pieces:
            while at < len(spans) and node > spans[at][1]:
                at += 1
            if at == len(spans):
                break
            if node < spans[at][0] or self.dropped[node]:
                continue
            if block != last:
                lines.append("".join(parts))
                parts, last = [], block
            parts.append(text)
        lines.append("".join(parts))
        trimmed = (" ".join(line.split()) for line in lines)
        return "\n".join(line for line in trimmed if line)

    def extract(self, keys: list[bytes]) -> str:
        """The text at the first of a host's paths that agrees with the page, else its own best."""
        own = self.best()
        if own is None:
            return ""
        least = AGREES * self.score(own)
        for key in keys:
            nodes = self.at(key)
            if nodes and sum(self.score(node) for node in nodes) >= least:
                return self.text(nodes)
        return self.text([own])


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for host, html in zip(rows["host"], rows["html"]):
            page = Page(html)
            best = page.best()
            if best:
                out.append((host, page.key[best], page.path(best)))
        votes = pd.DataFrame(out, columns=["host", "key", "path"])
        yield votes.groupby(["host", "key"], as_index=False).agg(path=("path", "first"), votes=("path", "size"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        texts = []
        for html, keys in zip(rows.column("html"), rows.column("keys")):
            texts.append(Page(html.as_py()).extract(keys.as_py() or []))
        columns = [rows.column("page_id"), rows.column("url"), pa.array(texts, type=pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host")
    )


def host_paths(pages: DataFrame) -> DataFrame:
    """Rows ``(host, key, path, votes)``: how many pages of a host find their article at a path.

    ``path`` is for reading; the key is its 128-bit hash. Votes are added within each batch and
    task before they are shuffled, so a host with a third of all pages is no large group.
    """
    found = _with_host(pages).mapInPandas(_vote, "host string, key binary, path string, votes long")
    return found.groupBy("host", "key").agg(F.min("path").alias("path"), F.sum("votes").alias("votes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages (page_id, url, html)`` to ``(page_id, url, text, n_chars)``, a row for each row.

    A null html is empty and gives an empty text, and so does a page without text. Pages whose url is
    null or names no host make up one host. Repeated rows each vote and each return; other columns
    are ignored. The paths of a host are joined to its pages: Spark broadcasts them if their table is
    small, and otherwise splits the join where a host is large.
    """
    order = Window.partitionBy("host").orderBy(F.col("votes").desc(), "key")
    ranked = written(host_paths(pages), "paths").withColumn("nth", F.row_number().over(order))
    chosen = F.sort_array(F.collect_list(F.struct("nth", "key")))
    paths = ranked.where(F.col("nth") <= PATHS).groupBy("host").agg(chosen.alias("found"))
    winners = written(paths.select("host", F.col("found.key").alias("keys")), "winners")
    joined = _with_host(pages).join(winners, "host", "left").select("page_id", "url", "html", "keys")
    types = {c: joined.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {types['page_id']}, url {types['url']}, text string"
    return joined.mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("long"))
