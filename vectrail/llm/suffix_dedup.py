"""Removal of byte strings that an earlier document holds too, by sorted suffixes.

Every string of ``width`` bytes holds a token start: the place where a hash of the ``KEY`` bytes from
there is smallest among all places within the string. Equal strings have it at the same place, so only the
suffixes at token starts are sorted, each with the bytes around it that its strings cover. Those whose
leading bytes no other text has are left out first. The others are dealt to ranges by sampled splitters
of their leading bytes, sorted in each range by multikey quicksort, and neighbours tell which
strings are equal. Equal leading bytes fall on one side of a splitter, so the ends of two ranges never
hold the same string, with one exception. Suffixes with a beginning so frequent that it fills whole ranges would be parted by
the boundaries; their strings are dealt by hash and compared across all ranges.

Texts stay in units of some megabytes. Between the steps, numbers of many suffixes travel as packed
arrays in one row.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.folds import bounded_sample
from vectrail.llm.hashing import mix, powers, prefix_sums
from vectrail.scratch import written

#: Bytes of a removed string; leading bytes by which its token start is chosen and first looked up.
WIDTH, KEY = 50, 25
LEFT = WIDTH - KEY
#: Bytes of texts in a unit, of texts that a task reads at once, and per task of the two sorts.
UNIT, FLUSH, LOOKUP, SORT = 2 << 20, 2 << 20, 24 << 20, 8 << 20
#: Bytes whose token starts are found at once, and strings that are compared at once.
STRETCH = 1 << 18
STRINGS = 1 << 17
#: Documents of the sample that gives splitters, and in how many of them a beginning is frequent.
SAMPLE, FREQUENT, LEADS = 4000, 6, 50_000
#: Sampled beginnings for each splitter at least. Ranges beyond that are shares of one by hash.
PER_CUT = 16
_LOW, _SIGN = np.uint64((1 << 24) - 1), np.uint64(1 << 63)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(data)))


def token_starts(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(place, first, last, key, doc)`` of the token starts of texts that lie behind each other:
    the strings that start at ``first`` to ``last`` belong to it, and no other strings do."""
    none = np.array([], dtype=np.int64)
    if len(data) < WIDTH:
        return none, none, none, none.astype(np.uint64), none
    ends = np.cumsum(sizes)
    whole = sizes >= WIDTH
    out = []
    # In stretches, so that the memory does not depend on the length of the texts.
    for at in range(0, len(data) - WIDTH + 1, STRETCH):
        part = data[at : at + STRETCH + WIDTH - 1]
        n = len(part) - KEY + 1
        sums = prefix_sums(part)
        _, down = powers(len(part) + 1)
        keys = mix((sums[KEY:] - sums[:n]) * down[:n])
        # The low bits hold the place, so that the first of equal hashes wins.
        low = (keys & ~_LOW) | np.arange(n, dtype=np.uint64)
        for shift in (1, 2, 4, 8):
            low = np.minimum(low[:-shift], low[shift:])
        low = np.minimum(low[: -(LEFT + 1 - 16)], low[LEFT + 1 - 16 :])
        open_at = np.zeros(len(low) + 1, dtype=np.int32)
        np.add.at(open_at, np.clip((ends - sizes)[whole] - at, 0, len(low)), 1)
        np.add.at(open_at, np.clip(ends[whole] - WIDTH + 1 - at, 0, len(low)), -1)
        strings = np.flatnonzero(np.cumsum(open_at[:-1]) > 0)
        places = (low[strings] & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(places, prepend=-1))
        # Least hashes are all small; mixed once more they spread over all ranges.
        out.append((strings + at, places + at, mix(keys[places[first]])))
        # A token start that goes on from the last stretch is there already.
        if len(out) > 1 and len(out[-2][1]) and len(places) and out[-2][1][-1] == places[0] + at:
            out[-1] = (*out[-1][:2], out[-1][2][1:])
    strings, places, keys = (np.concatenate(x) for x in zip(*out))
    if not len(strings):
        return none, none, none, none.astype(np.uint64), none
    new = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(new[1:], len(strings)) - 1
    place = places[new]
    return place, strings[new], strings[last], keys, np.searchsorted(ends, place, "right")


def multikey_sort(chars: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of 8-byte characters, equal ones by ``tie``, and the run of equal rows that
    each ordered row is in.

    Multikey quicksort: each open segment is parted in three about a pivot character of its level;
    smaller and larger rows stay at the level, equal ones go to the next, ``tie`` being the last.
    All open segments take a step at once. Rows that are equal throughout keep their order.
    """
    levels = chars.shape[1]
    order = np.arange(len(chars))
    new_run = np.zeros(len(chars), dtype=bool)
    begin, size, level = np.array([0]), np.array([len(chars)]), np.array([0])
    turn = 0
    while True:
        still = (size > 1) & (level <= levels)
        begin, size, level = begin[still], size[still], level[still]
        if not len(begin):
            break
        turn += 1
        offset = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(begin)), size)
        rows = order[np.arange(len(segment)) + (begin - offset)[segment]]
        value = _characters(chars, tie, rows, level[segment])
        # The median of three drawn places; drawn, so that no order of rows is slow.
        draws = mix(begin.astype(np.uint64) + (np.arange(3, dtype=np.uint64) + np.uint64(3 * turn))[:, None] * _LOW)
        three = value[offset + (draws % size.astype(np.uint64)).astype(np.int64)]
        pivot = np.sort(three, axis=0)[1][segment]
        less, more = value < pivot, value > pivot
        at, parts = begin, []
        for side, where in enumerate((less, ~(less | more), more)):
            number = np.add.reduceat(where, offset, dtype=np.int64)
            picked = np.flatnonzero(where)
            order[np.arange(len(picked)) + (at - np.cumsum(number) + number)[segment[picked]]] = rows[picked]
            new_run[at[(level < levels) & (number > 0)]] = True
            parts.append((at, number, level + (side == 1)))
            at = at + number
        begin, size, level = (np.concatenate(x) for x in zip(*parts))
    new_run[:1] = False
    return order, np.cumsum(new_run)


def _characters(chars: np.ndarray, tie: np.ndarray, rows: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The character of each row at its level; behind the last one, its ``tie``."""
    levels = chars.shape[1]
    value = chars[rows, np.minimum(level, levels - 1)]
    behind = np.flatnonzero(level == levels)
    value[behind] = tie[rows[behind]].astype(np.int64).view(np.uint64) ^ _SIGN
    return value


def _first_of_run(run: np.ndarray) -> np.ndarray:
    """For each ordered row the place of the first row of its run."""
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    return starts[run - run[0]] if len(run) else run


def _chars(rows: np.ndarray) -> np.ndarray:
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def suffix_rows(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of bytes for each token start: the suffix as far as its strings reach, the bytes before
    it that they cover, and both lengths, so that rows are equal exactly if all strings are."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(WIDTH, np.uint8)])
    before, after = place - first, last + WIDTH - place
    around = padded[place[:, None] + np.arange(LEFT + WIDTH)]
    column = np.arange(LEFT + WIDTH)
    around[column < (LEFT - before)[:, None]] = 0
    around[column >= (LEFT + after)[:, None]] = 0
    lengths = np.stack([before, after], axis=1).astype(np.uint8)
    return np.concatenate([around[:, LEFT:], around[:, :LEFT], lengths], axis=1)


def repeated(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose strings are all in a row of a smaller ``doc``, and of the others the rows and
    offsets of single strings that are: ``(whole, rest, row, offset)``; ``rest`` are the rows that
    stand for their equals."""
    order, run = multikey_sort(_chars(rows), doc)
    head = order[_first_of_run(run)]
    whole = doc[order] > doc[head]
    rest = order[~whole]
    # Rows with the same key whose surroundings differ can still share strings.
    key = rows[rest, :KEY]
    new = np.ones(len(rest), dtype=bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    alone = np.bincount(group, minlength=1)[group] == 1 if len(rest) else new
    members, groups = rest[~alone], group[~alone]
    found_r, found_o = [], []
    count = rows[members, -2].astype(np.int64) - (WIDTH - rows[members, -1].astype(np.int64)) + 1
    upto = np.cumsum(count)
    at = 0
    while at < len(members):
        # Some whole groups at once.
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STRINGS, "right")))
        while end < len(members) and groups[end] == groups[end - 1]:
            end += 1
        some = members[at:end]
        row, offset, strings = strings_of(rows[some])
        hit = repeated_strings(strings, doc[some][row])
        found_r.append(some[row[hit]])
        found_o.append(offset[hit])
        at = end
    none = np.array([], dtype=np.int64)
    return (
        order[whole],
        rest,
        np.concatenate(found_r) if found_r else none,
        np.concatenate(found_o) if found_o else none,
    )


def strings_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of suffix rows: the row, the bytes before the token start, and the string."""
    most, least = rows[:, -2].astype(np.int64), WIDTH - rows[:, -1].astype(np.int64)
    count = most - least + 1
    row = np.repeat(np.arange(len(rows)), count)
    offset = np.repeat(most, count) - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    around = np.concatenate([rows[:, WIDTH : WIDTH + LEFT], rows[:, :WIDTH]], axis=1)
    return row, offset, around[row[:, None], (LEFT - offset)[:, None] + np.arange(WIDTH)]


def repeated_strings(strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which strings an equal one of a smaller ``doc`` stands for."""
    order, run = multikey_sort(_chars(strings), doc)
    head = order[_first_of_run(run)]
    hit = np.zeros(len(doc), dtype=bool)
    hit[order] = doc[order] > doc[head]
    return hit


def _leading(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :8]).view(">u8")[:, 0].astype(np.uint64)


def _flushes(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= FLUSH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64)


def _by(group: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of columns by group: each group with its parts, in ascending order."""
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        pick = order[a:b]
        yield int(group[pick[0]]), *(c[pick] for c in columns)


def shares(ranges: int) -> tuple[int, int]:
    """Ranges that ``LEADS`` sampled beginnings can part, and into how many shares each is dealt by the
    hash of its keys, so that there are ``ranges`` tasks at least, however large the table is."""
    parted = min(ranges, max(1, LEADS // PER_CUT))
    return parted, -(-ranges // parted)


def split(lead: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of ordered sampled beginnings, and the beginnings that fill whole ranges."""
    cuts = lead[(np.arange(1, ranges) * len(lead)) // ranges] if len(lead) else lead
    values, times = np.unique(cuts, return_counts=True)
    return values, values[times > 1]


def _splitters(texts: DataFrame, ranges: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splitters of the leading bytes, the beginnings that fill whole ranges, and frequent keys, all
    from the texts of at most ``SAMPLE`` documents. They decide where work is done, not what is found."""
    chosen = bounded_sample(texts.select("rid").distinct(), "rid", SAMPLE, seed)

    def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, text in zip(batch["rid"], batch["text"]):
                data, sizes = _joined([text])
                place, _, _, keys, _ = token_starts(data, sizes)
                rows = np.frombuffer(text + bytes(8), dtype=np.uint8)[place[:, None] + np.arange(8)]
                lead = _leading(rows) ^ _SIGN
                yield pd.DataFrame({"lead": lead.view(np.int64), "key": keys.view(np.int64), "rid": rid})

    # At most SAMPLE ids are broadcast, and numbers of LEADS suffixes come to the driver.
    some = texts.select("rid", "text").join(F.broadcast(chosen), "rid")
    rows = written(some.mapInPandas(leads, "lead long, key long, rid long"), "token-starts")
    often = rows.groupBy("key").agg(F.count_distinct("rid").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "key").limit(LEADS).select("key").toPandas()
    lead = np.sort(bounded_sample(rows, "key", LEADS, seed).select("lead").toPandas()["lead"].to_numpy(np.int64))
    values, filled = split(lead, ranges)
    turned = lambda x: x.view(np.uint64) ^ _SIGN
    frequent = np.sort(often["key"].to_numpy(np.int64).view(np.uint64))
    return turned(values), turned(filled), frequent


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def remove_repeats(docs: DataFrame, seed: int = 8) -> DataFrame:
    """``(doc_id, text_hash, n_bytes, n_removed, n_spans, kept)``, one row per row of ``docs``; ``kept``
    are the bytes that are left of the text.

    Removed is each byte in a string of ``WIDTH`` bytes that also starts in a document with a
    smaller doc_id, judged on the whole input. Null texts are empty; a row with a null doc_id is
    not compared and stays whole; rows that share an id are not compared with each other. Exact
    copies of a text are found by hash and lose everything; only the first of them is sorted.
    Other columns are ignored; an empty table gives an empty one. ``text_hash`` names the text.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    ).withColumn("rid", F.xxhash64("doc_id", "text"))
    # pandas would make fractions of whole numbers beside nulls.
    texts = texts.withColumn("has_id", F.col("doc_id").isNotNull()).fillna(0, ["doc_id"])
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, lookups, ranges = (max(1, -(-total // size)) for size in (UNIT, LOOKUP, SORT))
    parted, share = shares(ranges)
    ranges = parted * share
    cuts, filled, frequent = _splitters(texts, parted, seed)
    shared = docs.sparkSession.sparkContext.broadcast((cuts, filled, frequent))
    in_units = texts.withColumn("unit", F.pmod("rid", F.lit(units)).cast("int"))

    same = texts.where(F.col("has_id") & (F.octet_length("text") >= WIDTH)).select(
        "doc_id", "rid", F.sha2("text", 256).alias("sha")
    )
    # A table of its own, so that Spark can split the join where one text has very many copies.
    groups = same.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1"), "copied-texts")
    copies = written(
        same.join(groups, "sha").where("doc_id > first").select(F.pmod("rid", F.lit(units)).cast("int").alias("unit"), "rid"),
        "copies",
    )

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Keys of all token starts, by range of the key."""
        _, _, frequent = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch["doc_id"], batch["rid"], batch["name"], batch["text"])

        for held in _flushes(rows()):
            held.sort(key=lambda row: row[:3])
            ones: dict[int, tuple] = {}
            for doc_id, rid, name, text in held:  # of the same text here, only the first can count
                ones.setdefault(name, (rid, text))
            rids = np.array([rid for rid, _ in ones.values()], dtype=np.int64)
            names = np.array(list(ones), dtype=np.int64)
            data, sizes = _joined([text for _, text in ones.values()])
            _, _, _, keys, doc = token_starts(data, sizes)
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            ask = ~_is_in(keys, frequent)
            keys, doc, nth = keys[ask], doc[ask], nth[ask]
            task = (((keys >> np.uint64(32)) * np.uint64(lookups)) >> np.uint64(32)).astype(np.int64)
            out = []
            for at, k, d, i in _by(task, keys, doc, nth):
                used, back = np.unique(d, return_inverse=True)
                low = k.astype(np.uint32)  # five bytes tell keys of one task apart
                high = (k >> np.uint64(32)).astype(np.uint8)
                sent = (rids[used], names[used], back.astype(np.uint32), i.astype(np.uint32), low, high)
                out.append((at, _pack(*sent)))
            yield pd.DataFrame(out, columns=["task", "sent"])

    def in_two(rows: pd.DataFrame) -> pd.DataFrame:
        """Token starts whose key another text has too, by unit."""
        parts = [_unpack(x) for x in rows["sent"]]
        key = np.concatenate([p[4].astype(np.uint64) | (p[5].astype(np.uint64) << np.uint64(32)) for p in parts])
        name = np.concatenate([p[1][p[2]] for p in parts])
        rid = np.concatenate([p[0][p[2]] for p in parts])
        nth = np.concatenate([p[3] for p in parts])
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        ordered = name[order]
        several = np.minimum.reduceat(ordered, starts) != np.maximum.reduceat(ordered, starts)
        hit = order[np.repeat(several, np.diff(starts, append=len(order)))]
        out = []
        for unit, r, i in _by(np.mod(rid[hit], units), rid[hit], nth[hit]):
            used, back = np.unique(r, return_inverse=True)
            out.append((unit, _pack(used, back.astype(np.uint32), i.astype(np.uint32))))
        return pd.DataFrame(out, columns=["unit", "told"])

    named = texts.where(F.col("has_id") & (F.octet_length("text") >= WIDTH))
    asked = named.select("doc_id", "rid", F.xxhash64("text").alias("name"), "text").mapInPandas(
        look_up, "task long, sent binary"
    )
    told = asked.groupBy("task").applyInPandas(in_two, "unit int, told binary")
    # A row without numbers names a copy.
    as_copy = copies.select("unit", "rid", F.lit(None).cast("binary").alias("told"))
    answers = told.select("unit", F.lit(0).cast("long").alias("rid"), "told").unionByName(as_copy)

    def suffixes(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Suffixes of a unit that other texts may share, by range of their leading bytes."""
        cuts, filled, frequent = shared.value
        skip = set(told.loc[told["told"].isna(), "rid"]) if len(told) else set()
        texts = texts[texts["has_id"] & ~texts["rid"].isin(skip)].drop_duplicates("rid")
        parts = [_unpack(x) for x in told["told"].dropna()] if len(told) else []
        asked_r = np.concatenate([p[0][p[1]] for p in parts]) if parts else np.array([], np.int64)
        asked_n = np.concatenate([p[2] for p in parts]) if parts else np.array([], np.uint32)
        out = []
        for held in _flushes(zip(texts["doc_id"], texts["rid"], texts["text"])):
            ids = np.array([row[0] for row in held], dtype=np.int64)
            rids = np.array([row[1] for row in held], dtype=np.int64)
            data, sizes = _joined([row[2] for row in held])
            place, first, last, keys, doc = token_starts(data, sizes)
            begin = np.searchsorted(doc, np.arange(len(held)))
            take = _is_in(keys, frequent)
            by_rid = np.argsort(rids)
            at = np.minimum(np.searchsorted(rids[by_rid], asked_r), len(rids) - 1)
            own = rids[by_rid][at] == asked_r
            take[begin[by_rid[at[own]]] + asked_n[own]] = True
            place, first, last, doc, keys = place[take], first[take], last[take], doc[take], keys[take]
            if not len(place):
                continue
            rows = suffix_rows(data, place, first, last)
            base = (np.cumsum(sizes) - sizes)[doc]
            of, rid, at = ids[doc], rids[doc], (place - base).astype(np.uint32)
            # Equal rows in this unit: all but the first are repeated, whatever other units hold.
            order, run = multikey_sort(_chars(rows), of)
            known = np.zeros(len(rows), dtype=bool)
            known[order] = of[order] > of[order[_first_of_run(run)]]
            lead = _leading(rows)
            # Strings that are equal share their key, so shares of a range need not meet.
            task = np.searchsorted(cuts, lead, "right").astype(np.int64) * share
            task += (mix(keys) % np.uint64(share)).astype(np.int64)
            over = _is_in(lead, filled) & ~known
            for range_, r, o, i, p, k in _by(task[~over], *(x[~over] for x in (rows, of, rid, at, known))):
                out.append((range_, _pack(r[~k], o[~k], i[~k], p[~k], r[k][:, -2:], i[k], p[k])))
            if over.any():
                picked = np.flatnonzero(over)
                for some in np.array_split(picked, -(-len(picked) * (LEFT + 1) // STRINGS)):
                    row, offset, strings = strings_of(rows[some])
                    hashed = mix(np.add.reduce(mix(_chars(strings) ^ mix(np.arange(7))), axis=1))
                    task = (hashed % np.uint64(ranges)).astype(np.int64) + ranges
                    start = at[some][row] - offset
                    for range_, s, o, i, p in _by(task, strings, of[some][row], rid[some][row], start):
                        out.append((range_, _pack(s, o, i, p.astype(np.uint32))))
        return pd.DataFrame(out, columns=["task", "rows"])

    def compare(sent: pd.DataFrame) -> pd.DataFrame:
        """Sort a range; the stretches of repeated strings go back to their units."""
        boundary = sent["task"].iloc[0] >= ranges
        parts = [_unpack(x) for x in sent["rows"]]
        rows, doc, rid, at = (np.concatenate([p[i] for p in parts]) for i in range(4))
        at = at.astype(np.int64)
        if boundary:
            hit = repeated_strings(rows, doc)
            rid, start = rid[hit], at[hit]
            length = np.full(len(start), WIDTH)
        else:
            whole, _, row, offset = repeated(rows, doc)
            lengths, k_rid, k_at = (np.concatenate([p[i] for p in parts]) for i in range(4, 7))
            before = np.concatenate([rows[whole, -2], lengths[:, 0]]).astype(np.int64)
            after = np.concatenate([rows[whole, -1], lengths[:, 1]]).astype(np.int64)
            start = np.concatenate([np.concatenate([at[whole], k_at.astype(np.int64)]) - before, at[row] - offset])
            length = np.concatenate([before + after, np.full(len(row), WIDTH)])
            rid = np.concatenate([rid[whole], k_rid, rid[row]])
        out = []
        for unit, r, s, n in _by(np.mod(rid, units), rid, start, length):
            used, back = np.unique(r, return_inverse=True)
            out.append((unit, _pack(used, back.astype(np.uint32), s.astype(np.uint32), n.astype(np.uint8))))
        return pd.DataFrame(out, columns=["unit", "told"])

    def cut(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """What is left of each text of a unit."""
        gone = set(told.loc[told["told"].isna(), "rid"]) if len(told) else set()
        parts = [_unpack(x) for x in told["told"].dropna()] if len(told) else []
        none = np.array([], np.int64)
        rid = np.concatenate([p[0][p[1]] for p in parts]) if parts else none
        start = np.concatenate([p[2].astype(np.int64) for p in parts]) if parts else none
        length = np.concatenate([p[3].astype(np.int64) for p in parts]) if parts else none
        order = np.argsort(rid, kind="stable")
        rid, start, length = rid[order], start[order], length[order]
        out = []
        for doc_id, has_id, own, text in zip(*(texts[c] for c in ("doc_id", "has_id", "rid", "text"))):
            data = np.frombuffer(text, dtype=np.uint8)
            a, b = np.searchsorted(rid, [own, own + 1]) if own < (1 << 63) - 1 else (np.searchsorted(rid, own), len(rid))
            if has_id and own in gone:
                removed = np.ones(len(data), dtype=bool)
            else:
                depth = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(depth, start[a:b], 1)
                np.add.at(depth, start[a:b] + length[a:b], -1)
                removed = np.cumsum(depth[:-1]) > 0
            spans = int(np.count_nonzero(np.diff(removed.astype(np.int8), prepend=0) == 1))
            kept = data[~removed].tobytes()
            out.append((doc_id, has_id, own, len(data), int(removed.sum()), spans, kept))
        names = ["doc_id", "has_id", "rid", "n_bytes", "n_removed", "n_spans", "kept"]
        return pd.DataFrame(out, columns=names)

    unit_texts = in_units.select("unit", "doc_id", "has_id", "rid", "text").groupBy("unit")
    met = unit_texts.cogroup(answers.groupBy("unit"))
    sent = met.applyInPandas(suffixes, "task long, rows binary")
    found = sent.groupBy("task").applyInPandas(compare, "unit int, told binary")
    spans = found.select("unit", F.lit(0).cast("long").alias("rid"), "told").unionByName(as_copy)
    again = in_units.select("unit", "doc_id", "has_id", "rid", "text").groupBy("unit").cogroup(spans.groupBy("unit"))
    schema = "doc_id long, has_id boolean, rid long, n_bytes long, n_removed long, n_spans long, kept binary"
    return again.applyInPandas(cut, schema).select(
        F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"),
        F.col("rid").alias("text_hash"),
        "n_bytes",
        "n_removed",
        "n_spans",
        "kept",
    )


def whole_characters(kept: Column) -> Column:
    """The text of kept bytes. A removed string may begin or end within a character; what is left of
    such a character goes too."""

    def decode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield text.map(lambda data: bytes(data).decode("utf-8", "ignore"))

    return F.pandas_udf(decode, "string")(kept)
