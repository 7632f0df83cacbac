"""Cheapest repair of damaged conversations by dynamic programming over compressed sequences.

A conversation is a sequence of symbols, one for the role and fault of each row. Equal sequences are
solved once. Those of a block are compressed by Re-Pair: the commonest pair of neighbours becomes a
rule, again and again. Every symbol and rule has one min-plus matrix from the state of the roles
before it to the state after it, and for each entry the rope of edits that attains it. The matrix of
a rule is the product of those of its two parts, so rules are worked out bottom up, and a sequence is
the product of the few symbols that are left of it.

Ropes of equal cost over equal rows never extend one another, as the longer one would hold more
insertions of cost 3. So their order does not change by what follows, and least ropes of parts make
the least rope of the whole.
"""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.scratch import written

#: Most symbols in one sequence; longer conversations are several, solved apart and then joined.
PIECE = 4096
#: Most symbols compressed together, and most rules made of them; what no rule covers is multiplied
#: symbol by symbol.
BLOCK, RULES = 1 << 18, 400

KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Costs of the edits, and of a truncated row that stays.
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: Role initial of a row, upper case if its text is truncated; rows that must go are ``D``.
SYMBOLS = "suaxSUAXD"
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79AC


class Rope:
    """A string of edits as a leaf or as two ropes, with its length and a hash of its letters."""

    __slots__ = ("text", "left", "right", "size", "code")

    def __init__(self, text="", left=None, right=None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size, self.code = len(text), 0
            for letter in text:
                self.code = (self.code * _BASE + ord(letter)) % _PRIME
        else:
            self.size = left.size + right.size
            self.code = (left.code * pow(_BASE, right.size, _PRIME) + right.code) % _PRIME

    def __add__(self, other: "Rope") -> "Rope":
        if not other.size:
            return self
        if not self.size:
            return other
        if self.left is None and other.left is None and self.size + other.size <= 32:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __str__(self) -> str:
        parts, left = [], [self]
        while left:
            rope = left.pop()
            if rope.left is None:
                parts.append(rope.text)
            else:
                left += [rope.right, rope.left]
        return "".join(parts)

    def __lt__(self, other: "Rope") -> bool:
        """Letter by letter, but parts that both hold at one place are skipped by length and hash."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a is b or a.size == b.size and a.code == b.code:
                continue
            if a.left is not None and (a.size >= b.size or b.left is None):
                mine += [a.right, a.left]
                theirs.append(b)
            elif b.left is not None:
                theirs += [b.right, b.left]
                mine.append(a)
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                if a.size > n:
                    mine.append(Rope(a.text[n:]))
                if b.size > n:
                    theirs.append(Rope(b.text[n:]))
        return bool(theirs) and not mine


#: An entry of a matrix is ``(cost, rope)`` or None; a matrix has a row of entries for each state.
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def _least(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    return b if b < a else a


def _times(row: list[Entry], matrix: Matrix) -> list[Entry]:
    """A row of entries times a matrix; only entries of least cost are joined."""
    out = []
    for j in range(STATES):
        best = None
        for left, entries in zip(row, matrix):
            right = entries[j]
            if left and right and (best is None or left[0] + right[0] <= best[0]):
                best = _least(best, (left[0] + right[0], left[1] + right[1]))
        out.append(best)
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product of two matrices, ties to the rope that is least in ASCII."""
    return [_times(row, right) for row in left]


def _insertions() -> Matrix:
    """What insertions alone can do: none, or one or two turns."""
    stay = [[(0, Rope()) if i == j else None for j in range(STATES)] for i in range(STATES)]
    once: Matrix = [[None] * STATES for _ in range(STATES)]
    for role in "ua":
        for i, j in NEXT[role].items():
            once[i][j] = (COSTS[INSERT], Rope(INSERT))
    twice = product(once, once)
    return [[_least(_least(a, b), c) for a, b, c in zip(*rows)] for rows in zip(stay, once, twice)]


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> Matrix:
    """The edits of one row and the insertions after it."""
    edits: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        edits[i][i] = (COSTS[DELETE], Rope(DELETE))
    if symbol != "D":
        extra = TRUNCATED_COST if symbol.isupper() else 0
        for edit, roles in ((KEEP, symbol.lower()), (REROLE, "ua")):
            for role in roles:
                for i, j in NEXT.get(role, {}).items():
                    edits[i][j] = _least(edits[i][j], (COSTS[edit] + extra, Rope(edit)))
    return product(edits, INSERTIONS)


def compress(sequences: list[str], most: int = RULES) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair over all sequences at once: rules, each of two earlier symbols, and what is left.

    The letters of SYMBOLS are the symbols from 0, rules follow them in order. No rule crosses the
    end of a sequence. Pairs that occur once make no rule; of equally common pairs the least is taken.
    """
    first = len(SYMBOLS)
    codes = {letter: i for i, letter in enumerate(SYMBOLS)}
    end = first + most
    flat = np.array([codes[c] if c != "|" else end for c in "|".join(sequences) + "|"], dtype=np.int64)
    rules: list[tuple[int, int]] = []
    while len(rules) < most:
        pairs = flat[:-1] * (end + 1) + flat[1:]
        pairs[(flat[:-1] == end) | (flat[1:] == end)] = -1
        found, counts = np.unique(pairs[pairs >= 0], return_counts=True)
        if not len(found) or counts.max() < 2:
            break
        pair = found[counts.argmax()]
        places = np.flatnonzero(pairs == pair)
        if pair // (end + 1) == pair % (end + 1):
            # In a run of one symbol every second place starts a pair.
            starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            nth = np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))
            places = places[nth % 2 == 0]
            if len(places) < 2:
                break
        flat[places] = first + len(rules)
        flat = np.delete(flat, places + 1)
        rules.append((int(pair // (end + 1)), int(pair % (end + 1))))
    ends = np.flatnonzero(flat == end)
    return rules, [flat[a:b] for a, b in zip(np.append(-1, ends[:-1]) + 1, ends)]


def solve(sequences: list[str]) -> list[Matrix]:
    """The matrix of every sequence; rules are worked out once, each from its two parts."""
    rules, left = compress(sequences)
    matrices = [symbol_matrix(symbol) for symbol in SYMBOLS]
    for a, b in rules:
        matrices.append(product(matrices[a], matrices[b]))
    nothing = [[(0, Rope()) if i == j else None for j in range(STATES)] for i in range(STATES)]
    out = []
    for symbols in left:
        matrix = matrices[symbols[0]] if len(symbols) else nothing
        for symbol in symbols[1:]:
            matrix = product(matrix, matrices[symbol])
        out.append(matrix)
    return out


def finish(row: list[Entry]) -> tuple[int, str]:
    """The least cost and its edits in a state that may end a conversation."""
    cost, rope = _least(row[START], row[ASSISTANT])
    return cost, str(rope)


def _solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def solved(block: list[str]) -> pd.DataFrame:
        flat = [[entry for row in matrix for entry in row] for matrix in solve(block)]
        costs = [[e[0] if e else None for e in entries] for entries in flat]
        edits = [[str(e[1]) if e else None for e in entries] for entries in flat]
        return pd.DataFrame({"symbols": block, "costs": costs, "edits": edits})

    block, size = [], 0
    for rows in batches:
        for symbols in rows["symbols"]:
            if block and size + len(symbols) > BLOCK:
                yield solved(block)
                block, size = [], 0
            block.append(symbols)
            size += len(symbols)
    if block:
        yield solved(block)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, copies)`` with damage planted by the hash of id and turn.

    Nulls are one space, in the hash and as role or text. A row with no copies was dropped.
    """
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    text, fate = F.coalesce("text", blank), F.crc32(name.cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


_ORDER = ["conv_id", "turn", "role", "digest"]


def mark_faults(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, copies)`` to one for each distinct row, without its text:
    ``(conv_id, turn, role, digest, copies, symbol, blank, duplicate, truncated)``.

    ``symbol`` stands for the first of the copies; the others are duplicates. Only digests of texts are
    shuffled, and equal rows are added before that. Texts are told apart by 128 bits.
    """
    there = F.col("copies") > 0
    words = r"[^\x20\x09-\x0D]"
    light = rows.select(
        "conv_id",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.col("role")).alias("role"),
        F.when(there, _digest(F.col("text"))).alias("digest"),
        F.when(there, ~F.col("text").rlike(words)).alias("empty"),
        F.when(there, ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        "copies",
    )
    distinct = written(light.groupBy(*_ORDER, "empty", "cut").agg(F.sum("copies").alias("copies")), "turns")
    # Turns in order with null first, as a struct that has an order itself.
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    several = (
        distinct.where("copies > 0 and not empty")
        .groupBy(F.col("conv_id").alias("conv"), F.col("role").alias("said_by"), F.col("digest").alias("said"))
        .agg(F.count("*").alias("n"), F.min(turn).alias("first"))
        .where("n > 1")
        .drop("n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("said_by")) & (F.col("digest") == F.col("said"))
    marked = distinct.join(several, same, "left")
    again = F.col("first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("there"), "turn") > F.col("first"))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    gone = F.col("copies") == 0
    symbol = F.when(gone, "").when(F.col("empty") | again, "D").when(F.col("cut"), F.upper(initial)).otherwise(initial)
    return marked.select(
        *_ORDER,
        "copies",
        symbol.alias("symbol"),
        F.when(~gone & F.col("empty"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(gone | F.col("empty"), 0).when(again, F.col("copies")).otherwise(F.col("copies") - 1).alias("duplicate"),
        F.when(symbol.isin("S", "U", "A", "X"), 1).otherwise(0).cast("long").alias("truncated"),
    )


# Fixed value: initials of neighbours that may follow each other.
_LEGAL = ("su", "ua", "au")
_COUNTS = ["n_turns", "illegal", "blank", "duplicate", "truncated"]
_PIECE_COLUMNS = ["conv_id", "place", "symbols", "first_turn", "last_turn", "first_role", "last_role", *_COUNTS]


class _Piece:
    """Symbols of up to PIECE rows that follow each other in a conversation, and counts over them.

    Of the pieces that one task cuts from a conversation only the first has first_turn and
    first_role; what lies between two of them is counted by the later one.
    """

    def __init__(self, conv, place: int, before: "_Piece | None" = None):
        self.conv_id, self.place, self.letters, self.size = conv, place, [], 0
        self.first_turn = self.first_role = None
        self.last_turn = before.last_turn if before else None
        self.last_role = before.last_role if before else None
        self.n_turns = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, initial: str, copies: int) -> None:
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in _LEGAL:
            self.illegal += 1
        self.last_role = initial
        self.illegal += copies - 1  # no role may follow itself
        if turn is not None and turn != self.last_turn:
            if self.last_turn is None:
                self.first_turn = turn
            self.last_turn = turn
            self.n_turns += 1

    @property
    def symbols(self) -> str:
        return "".join(self.letters)


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces; those of a task follow those of earlier tasks."""
    place, now, out = TaskContext.get().partitionId() << 40, None, []
    columns = ["conv_id", "turn", "role", "copies", "symbol", "blank", "duplicate", "truncated"]
    id_type = None

    def table() -> pa.RecordBatch:
        arrays = [pa.array([getattr(p, c) for p in out], type=id_type if c == "conv_id" else _TYPES.get(c, pa.int64())) for c in _PIECE_COLUMNS]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=_PIECE_COLUMNS)

    for rows in batches:
        id_type = rows.schema.field("conv_id").type
        for conv, turn, role, copies, symbol, *counts in zip(*(rows.column(c).to_pylist() for c in columns)):
            if now is None or now.conv_id != conv:
                if now is not None:
                    out.append(now)
                place += 1
                now = _Piece(conv, place)
            if not copies:
                continue
            now.add(turn, role[:1], copies)
            now.blank += counts[0]
            now.duplicate += counts[1]
            now.truncated += counts[2]
            left = copies
            while left:
                n = min(left, PIECE - now.size)
                now.letters.append(symbol + "D" * (n - 1))
                now.size += n
                left, symbol = left - n, "D"
                if now.size == PIECE:
                    out.append(now)
                    place += 1
                    now = _Piece(conv, place, now)
        if out:
            yield table()
    if now is not None:
        out.append(now)
        yield table()


_TYPES = {"symbols": pa.string(), "first_role": pa.string(), "last_role": pa.string()}
_STATISTICS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solved pieces in order to one row for each conversation, with the edits of its cheapest repair."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    columns = [*_PIECE_COLUMNS, "costs", "edits"]
    now, out, id_type = None, [], None

    def done() -> None:
        cost, audit = finish(now["row"])
        span = now["last_turn"] - now["least_turn"] + 1 - now["n_turns"] if now["n_turns"] else 0
        out.append((now["conv_id"], span, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit))

    def table() -> pa.RecordBatch:
        types = [id_type, *[pa.int64()] * 6, pa.string()]
        arrays = [pa.array(list(c), type=t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for rows in batches:
        id_type = rows.schema.field("conv_id").type
        for values in zip(*(rows.column(c).to_pylist() for c in columns)):
            piece = dict(zip(columns, values))
            if now is None or now["conv_id"] != piece["conv_id"]:
                if now is not None:
                    done()
                now = dict.fromkeys(_COUNTS, 0) | {
                    "conv_id": piece["conv_id"], "row": INSERTIONS[START], "last_turn": None, "last_role": None, "least_turn": None
                }
            for count in _COUNTS:
                now[count] += piece[count]
            if piece["first_turn"] is not None:
                if now["least_turn"] is None:
                    now["least_turn"] = piece["first_turn"]
                now["n_turns"] -= piece["first_turn"] == now["last_turn"]
            if piece["first_role"] is not None and now["last_role"] is not None:
                now["illegal"] += now["last_role"] + piece["first_role"] not in _LEGAL
            for last in ("last_turn", "last_role"):
                now[last] = now[last] if piece[last] is None else piece[last]
            if piece["symbols"]:
                entries = [None if c is None else (c, Rope(e)) for c, e in zip(piece["costs"], piece["edits"])]
                now["row"] = _times(now["row"], [entries[i : i + STATES] for i in range(0, len(entries), STATES)])
        if out:
            yield table()
    if now is not None:
        done()
        yield table()


def plan_repairs(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, copies)`` to ``(conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit)``, one for each conv_id.

    Rows are sorted into ranges of conversation and turn, so a conversation with a third of all rows
    spreads over a third of the tasks; its pieces are solved apart and joined by their matrices.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    ordered = written(mark_faults(rows), "marked").repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    longs = ", ".join(f"{c} long" for c in _COUNTS)
    schema = (
        f"conv_id {id_type}, place long, symbols string, first_turn long, last_turn long, "
        f"first_role string, last_role string, {longs}"
    )
    pieces = written(ordered.mapInArrow(_cut_pieces, schema), "pieces")
    distinct = pieces.select("symbols").where("symbols <> ''").distinct()
    solved = distinct.mapInPandas(_solve_batches, "symbols string, costs array<long>, edits array<string>")
    joined = pieces.join(solved, "symbols", "left").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return joined.mapInArrow(_join_pieces, f"conv_id {id_type}, {_STATISTICS}")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's plan, followed by its rows in order, to the plan with the repaired hash."""
    plan, out, lines = None, [], None

    def table() -> pa.RecordBatch:
        joined = pa.concat_tables([pa.Table.from_batches([row]) for row, _ in out]).combine_chunks()
        hashes = pa.array([h for _, h in out], type=pa.string())
        out.clear()
        return joined.append_column("repaired_sha256", hashes).to_batches()[0]

    for rows in batches:
        wanted = [i for i, name in enumerate(rows.schema.names) if name not in ("kind", "turn", "role", "digest", "text", "copies")]
        columns = [rows.column(c).to_pylist() for c in ("kind", "role", "text", "copies", "audit")]
        for i, (kind, role, text, copies, audit) in enumerate(zip(*columns)):
            if kind == 0:
                if plan is not None:
                    out.append((plan, lines.finish()))
                plan, lines = rows.slice(i, 1).select(wanted), Repair(audit)
            else:
                lines.add(role, text, copies)
        if out:
            yield table()
    if plan is not None:
        out.append((plan, lines.finish()))
        yield table()


class Repair:
    """Follows the edits of a conversation along its rows and hashes what is left of them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.turns, self.sha = audit, 0, 0, sha256()
        self.gap = b""

    def _say(self, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if self.turns % 2 else "user"
        # Users and assistants take turns after a system turn, which does not count.
        self.turns += role[:1] != "s"
        self.sha.update(self.gap + f"{role}:{text}".encode())
        self.gap = b"\n"

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT:
            self._say(None, "")
            self.at += 1

    def add(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit != DELETE:
                self._say(role if edit == KEEP else None, text)

    def finish(self) -> str:
        self._insert()
        return self.sha.hexdigest()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, copies)`` to one for each conv_id, a null one included:
    ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are ordered by turn with nulls first, then role and digest of the text. A conversation
    without copies has zeros, an empty audit and the hash of nothing. A hash of a whole text cannot be
    divided, so the rows of a conversation pass one task in order, in batches, for that column alone.
    """
    plans = written(plan_repairs(rows), "plans")
    names = [c for c in plans.columns if c != "conv_id"]
    said = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", "copies"
    )
    both = plans.select("conv_id", F.lit(0).alias("kind"), *names).unionByName(said, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_repaired, f"conv_id {id_type}, {_STATISTICS}, repaired_sha256 string")
