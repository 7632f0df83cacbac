"""Best-fit packing by length histogram.

Texts become token pieces of at most one sequence. The planner runs best-fit decreasing over the
counts of each length, not over pieces, and gives runs of slots: so many pieces of one length, in
sequences that follow each other. Each piece then finds its slot by its rank within its length.
"""

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.scratch import written

#: Distinct words, and distinct parts of words, whose ids a Python worker keeps; the longest it keeps.
CACHED_WORDS, CACHED_BYTES = 600_000, 64
RANK_BITS = 44


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: a printable one stands for itself,
    the others take the next free code points in turn (fixed values of the format)."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in printable else next(free)) for b in range(256)}


class _Parts(dict):
    """Ids of parts of words, each of which the tokenizer would merge on its own."""

    def __init__(self, path: str, cached: int):
        self.model, self.cached = _tokenizer(path).model, cached
        self.letters = _byte_letters()

    def __missing__(self, part: str) -> bytes:
        said = part.encode().decode("latin-1").translate(self.letters)
        packed = np.array([t.id for t in self.model.tokenize(said)], dtype="<u4").tobytes()
        if len(part) <= CACHED_BYTES and len(self) < self.cached:
            self[part] = packed
        return packed


#: Letters and numbers below U+0180, where every text is in normal form (fixed values of Unicode).
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: How the vocabulary's rules cut a text into parts (a fixed pattern of its file).
_CUT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+"
).findall
#: The same for texts without apostrophes: blanks go around numbers and runs of marks.
_APART = re.compile(f"([{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+)").sub
#: What other rules apply to: control tokens, control characters, other blanks, other scripts.
_OTHER = re.compile("<[|]|[\0-\x08\x0e-\x1f\x7f-\xa0\xad\u0180-\U0010ffff]").search
#: The same for texts of one byte a character: what is left of them without these is other.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *(c for c in range(161, 256) if c != 173)])
#: Bytes that are cut at once; a longer text is cut at a blank behind each so many.
_STRETCH = 1 << 20


class _Ids:
    """Ids of texts as packed unsigned 32-bit numbers.

    The tokenizer lower-cases, drops white space, and merges the parts between on their own. Texts
    of Latin letters, digits and marks are cut by the vocabulary's pattern, and only parts not seen
    before are merged. Words of all other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.encode, self.cached = _tokenizer(path).encode, cached
        self.parts = _Parts(path, cached)
        self.words: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            ids = self.encode(word.decode(), add_special_tokens=False).ids
            packed = np.array(ids, dtype="<u4").tobytes()
            if len(word) <= CACHED_BYTES and len(self.words) < self.cached:
                self.words[word] = packed
        return packed

    def of(self, data: bytes) -> bytes:
        out, at = [], 0
        while at < len(data):
            end = _BLANK(data, at + _STRETCH)
            stretch = data[at : end.start() if end else len(data)]
            at += len(stretch)
            low = stretch.decode().lower()
            if _is_other(low):
                out.extend(map(self.word, stretch.split()))
            elif "'" in low:
                out.extend(map(self.parts.__getitem__, _CUT(low)))
            else:
                out.extend(map(self.parts.__getitem__, _APART(r" \1 ", low).split()))
        return b"".join(out)


def _is_other(low: str) -> bool:
    """Whether a lower-cased text needs the whole tokenizer."""
    try:
        return "<|" in low or bool(low.encode("latin-1").translate(None, _PLAIN))
    except UnicodeEncodeError:
        return bool(_OTHER(low))


_BLANK = re.compile(rb"[ \t-\r]").search


@lru_cache(maxsize=1)
def _ids(path: str, cached: int) -> _Ids:
    return _Ids(path, cached)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
    cached: int = CACHED_WORDS,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's ids and the end id.

    Null texts are empty and give the end id alone. Only documents longer than ``capacity`` are cut.
    ``with_ids`` adds the ids themselves, as little-endian unsigned 32-bit numbers. ``cached`` words
    stay in each Python worker for its next tasks: fewer take less memory and more time. Repeated rows
    give pieces of their own; other columns are ignored.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = _ids(tokenizer_path, cached)
        for batch in batches:
            # One text at a time: a batch of very long texts would hold many ids at once.
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                ids = tokens.of(data) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut))
                    rows.append(row + (cut,) if with_ids else row)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds + [pa.binary()] * with_ids)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(
        pieces, schema + (", ids binary" if with_ids else "")
    )


def plan_slots(counts: dict[int, int], capacity: int = 4096) -> np.ndarray:
    """Best-fit decreasing over a histogram: rows ``(length, first rank, first sequence, pieces a
    sequence, offset)``, ordered by length and rank.

    A run of sequences with equal room is filled as a whole and is split in three at most, so there
    are at most 2 runs a length and one length adds one row to each run that takes it. A sequence
    holds at most sqrt(2 * capacity) different lengths, which bounds the rows by
    2 * capacity * sqrt(2 * capacity), whatever the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, sequences)
    rooms: list[int] = []  # sorted keys of room
    rows, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                bisect.insort(rooms, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first = capacity, sequences
                n = -(-todo // (capacity // length))
                sequences += n
            each = left // length
            full, rest = min(n, todo // each), 0
            rows.append((length, rank, first, each, capacity - left))
            if full < n:
                rest = todo - full * each
                put(left - rest * length, first + full, 1)
                put(left, first + full + 1, n - full - 1)
            put(left - each * length, first, full)
            todo -= full * each + rest
            rank += full * each + rest
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def rank_within(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` of each row among those of its length, from 0.

    Rows of a length are spread by a hash, numbered within their share, and shifted by the counts of
    the shares before, so a length that holds most rows is not numbered in one task.
    """
    shares = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64(*order), F.lit(shares)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("length", "share")
        .agg(F.count("*").alias("n"))
        .select("length", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("length", "share").orderBy(*order)
    numbered = dealt.withColumn("local", F.row_number().over(within) - 1)
    return (
        numbered.join(shifts, ["length", "share"])
        .withColumn("rank", F.col("local") + F.col("shift"))
        .drop("share", "local", "shift")
    )


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: no sequence holds more than ``capacity``
    tokens and its pieces follow each other from 0 without gaps.

    ``pieces`` is read twice, so it should be a stored table. Only the histogram, of at most
    ``capacity`` rows, comes to the driver, and only the plan goes to the tasks (its bound is in
    :func:`plan_slots`). An empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(plan_slots(counts, capacity))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        length, first_rank, first, each, offset = plan.value.T
        keys = (length << RANK_BITS) + first_rank
        for own, rank in batches:
            own, rank = own.to_numpy(np.int64), rank.to_numpy(np.int64)
            at = np.searchsorted(keys, (own << RANK_BITS) + rank, "right") - 1
            nth = rank - first_rank[at]
            yield pd.DataFrame(
                {
                    "sequence_id": first[at] + nth // each[at],
                    "offset": offset[at] + nth % each[at] * length[at],
                }
            )

    ranked = rank_within(pieces, ["doc_id", "piece"])
    placed = ranked.withColumn("slot", place("length", "rank"))
    return placed.select(*pieces.columns, "slot.sequence_id", "slot.offset")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, cached: int = CACHED_WORDS
) -> DataFrame:
    """Tokenize and pack whole documents; see :func:`token_pieces` and :func:`pack`."""
    pieces = token_pieces(docs, tokenizer_path, capacity, cached=cached)
    return pack(written(pieces, "pieces"), capacity)
