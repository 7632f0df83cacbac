"""The similarity join against all pairs."""

import random
import tracemalloc

import pytest

from vectrail.llm import hashing, jaccard_join
from vectrail.llm.components import stars

SCHEMA = "doc_id long, text string, set_id string, name string"


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed):
    some = random.Random(seed)
    words = [f"W{n}é" if n % 9 == 0 else f"w{n}" for n in range(300)]
    bases = [some.choices(words, k=n) for n in (1, 2, 3, 4, 12, 13, 25, 40, 60, 90, 200, 700)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three"]
    for base in bases:
        for _ in range(18):
            made = list(base)
            for _ in range(some.choice([0, 0, 1, 1, 2, max(1, len(base) // 40), len(base) // 20])):
                made[some.randrange(len(made))] = some.choice(words)
            texts.append(some.choice([" ", "\n", "\x0b"]).join(made[: len(made) - some.randint(0, len(made) // 25)]))
    some.shuffle(texts)
    return [(10**15 + i if i % 7 == 0 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("tile", [jaccard_join.TILE, 4])
def test_classes_equal_all_pairs(spark, tile):
    rows = corpus(tile)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = jaccard_join.similarity_classes(df, tile=tile).collect()
    assert sorted(map(tuple, found)) == classes(rows)


def test_repeated_and_missing_ids_and_no_rows(spark):
    rows = [(5, "a b c d", "", ""), (5, "a b c d", "", ""), (4, "A b c d", "", ""), (None, "a b c d", "", ""), (6, "x", "", "")]
    found = jaccard_join.similarity_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(5, 2, 4), (5, 2, 4), (4, 2, 4), (None, 2, None), (6, 1, 6)], key=str)
    assert jaccard_join.similarity_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_give_the_same_sets(monkeypatch):
    some = random.Random(9)
    words = ["W%dé" % n for n in range(50)] + ["x" * 40]
    texts = [" ".join(some.choices(words, k=n)).encode() for n in (0, 1, 2, 3, 30, 400, 7, 900)]
    texts += [b"", b" " * 90, b"y" * 300, b" " + b"z" * 64, b"a b " * 200]
    want = jaccard_join.shingle_sets(texts, 5, long=1 << 30)
    for stretch in (1, 2, 7, 64):
        monkeypatch.setattr(hashing, "STRETCH", stretch)
        monkeypatch.setattr(jaccard_join, "CHUNK", 11 * stretch)
        for long in (1 << 30, 100, 0):
            for a, b in zip(want, jaccard_join.shingle_sets(texts, 5, long=long)):
                assert len(a) == len(b) and (a == b).all()


def test_memory_of_a_long_text():
    some = random.Random(10)
    words = [b"w%d" % n for n in range(100_000)]
    text = b" ".join(some.choices(words, k=2_400_000))  # 16 MB, its shingles all different
    tracemalloc.start()
    hashes, _ = jaccard_join.shingle_sets([text], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) > 2_390_000 and peak < 7 * len(text), peak / len(text)


def test_two_sets_that_link_share_a_part():
    some = random.Random(8)
    for _ in range(300):
        n = some.randint(1, 400)
        both = some.sample(range(10**6), n)
        most = n // 9
        extra = some.randint(0, most)
        left = some.randint(0, extra)
        a = both + some.sample(range(10**6, 2 * 10**6), left)
        b = both + some.sample(range(2 * 10**6, 3 * 10**6), extra - left)
        if 100 * n < 90 * (n + extra):
            continue
        import numpy as np

        sets = [np.sort(np.array(x, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in (a, b)]
        keys, bounds = jaccard_join.part_keys(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]), 90)
        assert set(keys[: bounds[1]]) & set(keys[bounds[1] :]), (len(a), len(b))


def test_stars_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component_id"] for r in stars(df).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in [*range(101, 150), 200]}}
