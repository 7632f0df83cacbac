"""Reading bibliographic XML dumps."""

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.entities import html5
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vectrail.functions import text as X
from vectrail.schema import ARTICLE_COLUMNS, RAW_ARTICLE, SOURCE_ORDER

# The names of the source files, and the element that holds one record.
FILE_PATTERN = "*.{xml,xml.gz}"
RECORD_END = "</PubmedArticle>"
# Bytes of records that a worker parses at a time, or one record if it is longer.
PARSED_BYTES = 1 << 20
_RECORD_START = re.compile(r"<PubmedArticle[\s>]")

_XML_ENTITIES = {"amp", "lt", "gt", "quot", "apos"}
_ENTITY = re.compile(r"""<!ENTITY\s+([\w.-]+)\s+["']([^"']*)["']""")
_REFERENCE = re.compile(r"&([A-Za-z][\w.-]*);")
_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")

_PARSED = T.StructType([*RAW_ARTICLE.fields, T.StructField("error", T.StringType())])
_ARROW_TYPE = to_arrow_type(_PARSED)


def source_files(spark: SparkSession, path: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """The source files below ``path`` as ``(file_name, n_bytes)``; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes")
    )


def record_options(pattern: str = FILE_PATTERN) -> dict[str, str]:
    """Options of the text source that cut files at the end of each record.

    Plain files are split among tasks at record ends, and compressed ones are read as a stream, so
    no file is ever held in memory.
    """
    return {"lineSep": RECORD_END, "pathGlobFilter": pattern}


def record_columns() -> list:
    """The record text and where it starts, for a text source read with these options."""
    return [
        F.col("value"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
    ]


def read_records(spark: SparkSession, path: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """The text of every record with its position in the source."""
    lines = spark.read.options(**record_options(pattern)).text(path).select(*record_columns())
    return positioned(lines)


def positioned(lines: DataFrame) -> DataFrame:
    """Number the pieces of a batch read, and leave out those that hold no record."""
    numbered = lines.withColumn("source_row", F.monotonically_increasing_id())
    return numbered.where(F.col("value").rlike(_RECORD_START.pattern))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where its records, its first column, reach ``PARSED_BYTES``; none is empty."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(0)).to_pylist()):
        if i > start and size + n > PARSED_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _parsed(records: DataFrame, text_mode: str, *others: str) -> DataFrame:
    """The raw fields of each record, or its ``error``, beside other columns.

    Records are parsed in pieces, so a worker holds the Python objects of one piece and not of a
    whole Arrow batch.
    """
    texts = _TEXTS[text_mode]

    def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in _pieces(b)):
            parsed = []
            for record in piece.column(0):
                try:
                    root = _element(record.as_py())
                    parsed.append({**_fields(root), **texts(root), "error": None})
                except ET.ParseError as error:
                    parsed.append({"error": str(error)})
            fields = pa.array(parsed, type=_ARROW_TYPE).flatten()
            yield pa.RecordBatch.from_arrays([*fields, *piece.columns[1:]], names=schema.names)

    kept = records.select(F.col("value").alias("record"), *others)
    schema = T.StructType([*_PARSED.fields, *kept.schema.fields[1:]])
    return kept.mapInArrow(_parse, schema)


def _element(record: str) -> ET.Element:
    """One record as an element, on its own.

    The record is cut out of its file, so it may use namespace prefixes and entities that the file
    declares before it. Prefixes are declared anew, as no element that is read has one, and
    entities of HTML, and those declared in the part before the record if it is there, are replaced.
    """
    start = _RECORD_START.search(record).start()
    text = record[start:] + RECORD_END
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        declared = dict(_ENTITY.findall(record[:start]))
        text = _REFERENCE.sub(lambda m: _resolved(m, declared), text)
        prefixes = sorted(set(_PREFIX.findall(text)) - {"xml", "xmlns"})
        names = " ".join(f'xmlns:{p}="urn:{p}"' for p in prefixes)
        return ET.fromstring(f"<records {names}>{text}</records>")[0]


def _resolved(reference: re.Match, declared: dict[str, str]) -> str:
    name = reference[1]
    if name in _XML_ENTITIES:
        return reference[0]
    if name in declared:
        return declared[name]
    return escape(html5[f"{name};"]) if f"{name};" in html5 else reference[0]


def _leading_texts(root: ET.Element) -> dict:
    """Title and abstract up to their first child, the abstract of the first section alone."""
    return {"title": root.findtext(".//ArticleTitle"), "abstract": root.findtext(".//AbstractText")}


def _whole(element: ET.Element | None) -> str | None:
    """All text below an element with its inline markup taken off and white space made single."""
    return None if element is None else " ".join("".join(element.itertext()).split())


def _full_texts(root: ET.Element) -> dict:
    """Whole title and abstract: a line for each section, after its label if it has one.

    Other abstracts of a record, as in another language, and sections without text are left out.
    """
    first = root.find(".//Abstract")
    sections = root.findall(".//AbstractText") if first is None else first.findall(".//AbstractText")
    lines = []
    for section in sections:
        text, label = _whole(section), (section.get("Label") or "").strip()
        if text:
            lines.append(f"{label}: {text}" if label else text)
    return {"title": _whole(root.find(".//ArticleTitle")), "abstract": "\n".join(lines) or None}


_TEXTS = {"leading": _leading_texts, "full": _full_texts}


def _fields(root: ET.Element) -> dict:
    """The other fields of one record: of each element the first match, up to its first child."""
    # The paths of the fields in the input format.
    return {
        "pmid": root.findtext(".//PMID"),
        "year": root.findtext(".//PubDate/Year"),
        "medline_date": root.findtext(".//PubDate/MedlineDate"),
        "authors": [
            {"fore_name": a.findtext("ForeName"), "last_name": a.findtext("LastName")}
            for a in root.iter("Author")
        ],
    }


def parse_records(
    records: DataFrame, on_bad_record: str = "error", text_mode: str = "leading"
) -> DataFrame:
    """The valid articles among record texts, with their position in the source.

    Titles and abstracts are read up to their first child element, abstracts in their first section,
    or with ``text_mode='full'`` whole: with the text inside markup and all labelled sections.
    A record that is not well-formed fails the job, or with ``on_bad_record='skip'`` is left out;
    :func:`bad_records` has those.
    """
    if on_bad_record not in ("error", "skip"):
        raise ValueError(f"on_bad_record must be 'error' or 'skip', not {on_bad_record!r}")
    if text_mode not in _TEXTS:
        raise ValueError(f"text_mode must be one of {sorted(_TEXTS)}, not {text_mode!r}")
    parsed = _parsed(records, text_mode, *SOURCE_ORDER)
    error = F.col("error")
    if on_bad_record == "error":
        # The guard stands in the id, which every row needs, so that it is never pruned away.
        pmid = F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.col("pmid"))
        parsed = parsed.withColumn("pmid", pmid)
    else:
        parsed = parsed.where(error.isNull())
    return to_articles(parsed.drop("error"))


def bad_records(records: DataFrame) -> DataFrame:
    """The records that are not well-formed, as ``(value, error)`` with their position."""
    parsed = _parsed(records, "leading", "value", *SOURCE_ORDER)
    return parsed.where(F.col("error").isNotNull()).select("value", "error", *SOURCE_ORDER)


def to_articles(fields: DataFrame) -> DataFrame:
    """Article columns from raw text fields; records without id or without any text are dropped."""
    pmid, year, date = F.col("pmid"), F.col("year"), F.col("medline_date")
    valid = fields.where(X.is_valid_article(pmid, F.col("title"), F.col("abstract")))
    derived = {
        "doc_id": pmid.try_cast("bigint"),
        "authors": X.author_list(F.col("authors")),
        "publication_year": X.publication_year(year, date),
        "publication_year_raw": X.publication_year_raw(year, date),
    }
    others = [c for c in fields.columns if c not in RAW_ARTICLE.names]
    return valid.withColumns(derived).select(*ARTICLE_COLUMNS, *others)


def read_articles(
    spark: SparkSession,
    path: str,
    pattern: str = FILE_PATTERN,
    rebalance: bool = False,
    on_bad_record: str = "error",
    text_mode: str = "leading",
) -> DataFrame:
    """The valid articles of all XML files below ``path``, repeated ids included.

    Each comes with ``source_file, source_block, source_row``, its place in the source. A compressed
    file can only be unpacked by one task; if a few hold most of the data, ``rebalance`` evens out
    their records among tasks before parsing.
    """
    records = read_records(spark, path, pattern)
    return parse_records(records.hint("rebalance") if rebalance else records, on_bad_record, text_mode)
