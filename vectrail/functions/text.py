"""Column functions over article fields."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank, and the prefixes of the embedding tasks.
NON_BLANK = (
    r"[^\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = ""


def _present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def is_valid_article(pmid: Column, title: Column, abstract: Column) -> Column:
    """True iff there is an id and a title or an abstract; empty text counts as missing."""
    return _present(pmid).isNotNull() & F.coalesce(_present(title), _present(abstract)).isNotNull()


def publication_year_raw(year: Column, medline_date: Column) -> Column:
    """The year element, or else the first four characters of the free-text date."""
    return F.coalesce(_present(year), F.substring(medline_date, 1, 4))


def publication_year(year: Column, medline_date: Column) -> Column:
    """The publication year as a number; NULL when the date does not start with one."""
    return publication_year_raw(year, medline_date).try_cast("int")


def author_list(authors: Column) -> Column:
    """``Fore Last`` of every author who has both names, joined by commas; ``''`` when none has."""
    named = F.filter(
        authors,
        lambda a: _present(a["fore_name"]).isNotNull() & _present(a["last_name"]).isNotNull(),
    )
    shown = F.transform(named, lambda a: F.concat(a["fore_name"], F.lit(" "), a["last_name"]))
    return F.coalesce(F.array_join(shown, ", "), F.lit(""))


def embedding_text(title: Column, abstract: Column) -> Column:
    """The abstract, or the title when the abstract is missing or blank."""
    return F.when(abstract.rlike(NON_BLANK), abstract).otherwise(title)


def with_prefix(text: Column, prefix: str) -> Column:
    """The text as the model sees it, behind its task prefix."""
    return F.concat(F.lit(prefix), text) if prefix else text


def truncate_tokens(text: Column, max_tokens: int) -> Column:
    """The first ``max_tokens`` whitespace-separated tokens, joined by single spaces."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.array_join(F.slice(tokens, 1, max_tokens), " ")
