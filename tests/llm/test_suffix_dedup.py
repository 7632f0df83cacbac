"""Removal of repeated strings against brute force over all strings."""

import random

import numpy as np
import pytest

from vectrail.llm import suffix_dedup

SCHEMA = "doc_id long, text string, rid string, unit string"


def brute(rows):
    """Per row: bytes, removed bytes, spans, kept bytes."""
    strings = {}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        if doc_id is not None:
            for i in range(len(data) - 49):
                s = data[i : i + 50]
                strings[s] = min(strings.get(s, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = [False] * (len(data) + 1)
        for i in range(len(data) - 49 if doc_id is not None else 0):
            if strings[data[i : i + 50]] < doc_id:
                gone[i : i + 50] = [True] * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(data)))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, kept))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *(x or 0 for x in r[:-1]), r[-1]))


def corpus(seed):
    some = random.Random(seed)
    words = ["".join(some.choices("abcdeé", k=some.randint(1, 7))) for _ in range(40)]
    prose = lambda n: " ".join(some.choices(words, k=n))
    passages = [prose(some.randint(8, 40)) for _ in range(6)]
    line = "the very common line that stands in most of the documents of this small corpus\n"
    rows = []
    for i in range(160):
        text = prose(some.randint(0, 60))
        if i % 3:
            text += some.choice(passages)
        if i % 4:
            text = line + text + prose(some.randint(0, 5))
        if i % 11 == 0 and rows:
            text = rows[some.randrange(len(rows))][1] or ""
        if i % 13 == 0 and text:
            at = some.randrange(len(text))
            text = text[:at] + some.choice("xyz") + text[at + 1 :]
        rows.append((some.randrange(10**17) if i % 5 else i, text, "r", "u"))
    rows += [(7, "a" * 49, "r", "u"), (8, "a" * 400, "r", "u"), (9, "ab" * 3000, "r", "u"), (10, "ab" * 30, "r", "u")]
    rows += [(None, rows[3][1], "r", "u"), (11, None, "r", "u"), (12, "", "r", "u")]
    rows += [rows[20], rows[20], (rows[20][0], line * 2, "r", "u"), (2**62, line * 2, "r", "u")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_in_many_units_and_ranges(spark, monkeypatch, seed):
    for name, value in (("UNIT", 3000), ("LOOKUP", 4000), ("SORT", 1500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [
        (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
        for r in suffix_dedup.remove_repeats(df).collect()
    ]
    assert order(found) == order(brute(rows))


def test_shares_of_ranges_find_the_same(spark, monkeypatch):
    for name, value in (("UNIT", 3000), ("LOOKUP", 4000), ("SORT", 500), ("LEADS", 60), ("PER_CUT", 20)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(3)
    ranges = -(-sum(len((r[1] or "").encode()) for r in rows) // 500)
    assert suffix_dedup.shares(ranges) == (3, -(-ranges // 3)) and ranges > 30
    found = [
        (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
        for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    ]
    assert order(found) == order(brute(rows))


@pytest.mark.parametrize("ranges", [1, 3000, 60_000, 12_500_000])
def test_splitters_of_very_many_ranges_fill_none(ranges):
    parted, share = suffix_dedup.shares(ranges)
    assert ranges <= parted * share < ranges + parted
    lead = np.sort(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, suffix_dedup.LEADS))
    cuts, filled = suffix_dedup.split(lead, parted)
    assert len(cuts) == parted - 1 and not len(filled)
    lead[20_000:24_000] = lead[20_000]  # a beginning that a twelfth of all suffixes have
    assert parted == 1 or suffix_dedup.split(lead, parted)[1].tolist() == [lead[20_000]]


def test_no_rows(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_multikey_sort_orders_and_groups():
    some = np.random.default_rng(3)
    chars = some.integers(0, 3, (500, 4)).astype(np.uint64)
    tie = some.integers(0, 9, 500)
    found, run = suffix_dedup.multikey_sort(chars, tie)
    rows = [(*map(int, chars[i]), int(tie[i])) for i in found]
    assert rows == sorted(rows)
    assert [a[:4] == b[:4] for a, b in zip(rows, rows[1:])] == [int(a) == int(b) for a, b in zip(run, run[1:])]


def test_multikey_sort_of_large_and_odd_inputs():
    some = np.random.default_rng(4)
    for chars, tie in (
        (np.zeros((0, 3), np.uint64), np.zeros(0, np.int64)),
        (np.full((1, 2), 2**64 - 1, np.uint64), np.array([-1])),
        (np.zeros((5000, 3), np.uint64), some.integers(-(2**63), 2**63 - 1, 5000)),
        (np.sort(some.integers(0, 2**64, (20_000, 2), dtype=np.uint64), axis=0), np.arange(20_000)[::-1]),
        (some.integers(0, 2**64, (20_000, 1), dtype=np.uint64) >> np.uint64(50), np.zeros(20_000, np.int64)),
    ):
        order, run = suffix_dedup.multikey_sort(chars, tie)
        keys = (tie, *(chars[:, i] for i in reversed(range(chars.shape[1]))))
        assert (order == np.lexsort(keys)).all()  # stable, so equal throughout
        new = (chars[order][1:] != chars[order][:-1]).any(axis=1)
        assert (np.diff(run) == new).all()


def test_every_string_has_one_token_start_and_equal_ones_the_same():
    some = random.Random(5)
    texts = [bytes(some.choices(b"ab ", k=some.randint(0, 300))) for _ in range(20)]
    data, sizes = suffix_dedup._joined(texts)
    place, first, last, _, doc = suffix_dedup.token_starts(data, sizes)
    at, seen, n = {}, {}, 0
    for p, a, b, d in zip(place, first, last, doc):
        for i in range(a, b + 1):
            assert i not in at and i <= p <= i + 25
            at[i] = p
            n += 1
            assert seen.setdefault(bytes(data[i : i + 50]), p - i) == p - i
            assert sizes[:d].sum() <= i and i + 50 <= sizes[: d + 1].sum()
    assert n == sum(max(0, s - 49) for s in sizes)


def test_stretches_do_not_change_token_starts(monkeypatch):
    some = random.Random(6)
    texts = [bytes(some.choices(b"ab ", k=n)) for n in (700, 10, 49, 50, 51, 300, 0, 999)]
    whole = suffix_dedup.token_starts(*suffix_dedup._joined(texts))
    for stretch in (1, 7, 64, 1000):
        monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
        for a, b in zip(whole, suffix_dedup.token_starts(*suffix_dedup._joined(texts))):
            assert (a == b).all()
