"""Packing: ids against the tokenizer, slots against the capacity."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vectrail.llm import best_fit

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, length string, rank string"


def brute(text, capacity):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]
    cuts = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
    return [(i, i * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cuts)]


def test_ids_equal_the_tokenizers(monkeypatch):
    monkeypatch.setattr(best_fit, "_STRETCH", 7)
    tokenizer, ids = Tokenizer.from_file(PATH), best_fit._Ids(PATH)
    some = random.Random(6)
    pool = list("abzAZÉéßÀİŉªº ,.;:!?'\"0129½²-_/\\<|>\t\n\x0b\x0c\x85\xa0 ​Σσς漢字😀é̀ﬁ\xad\x00\x1c\x1f")
    pool += ["<|endoftext|>", "'s", "'LL", "I'm", "<|ENDOFTEXT|>", "K", "Å"]
    for _ in range(3000):
        text = "".join(some.choices(pool, k=some.randint(1, 25)))
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == expected, repr(text)


def test_packed_documents(spark):
    texts = [None, "", "word", "word", "two words"] + ["a b c d e " * n for n in (1, 3, 7, 20, 50)] * 4
    docs = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, "word", "x", "y"), (None, "no id", "x", "y")]
    rows = best_fit.pack_documents(spark.createDataFrame(docs, SCHEMA), PATH, 16).collect()
    expected = sorted((i is None, i or 0, *p) for i, t, *_ in docs for p in brute(t, 16))
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert found == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    assert len(sequences) <= sum(r["length"] for r in rows) / 16 * 1.1 + 1


def test_no_documents(spark):
    assert best_fit.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    some = random.Random(seed)
    capacity = some.choice([10, 37, 64])
    counts = {n: some.randint(1, 40) for n in some.sample(range(1, capacity + 1), some.randint(1, 10))}
    room = []  # best fit, one piece at a time
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(r, i) for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(capacity - length)
    plan = best_fit.plan_slots(counts, capacity)
    filled = {}
    for length, n in counts.items():
        own = plan[plan[:, 0] == length]
        for rank in range(n):
            _, first_rank, first, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            nth = rank - first_rank
            filled.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
    for parts in filled.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    assert len(filled) == len(room)
