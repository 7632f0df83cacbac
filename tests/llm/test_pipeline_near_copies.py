"""The near-duplicate stage against all pairs by five-word shingles at 0.8."""

import random

import corpus_pipeline as P
from tests.llm.test_jaccard_join import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def roots(rows):
    """The smallest id that links reach, of each id."""
    sets = [(i, shingles(t, 5)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def edited(words, places):
    return [f"new{i}" if i in places else w for i, w in enumerate(words)]


def stage(spark, rows):
    made = [(i, t, "en", "src0", len(t)) for i, t in rows]
    return P.keep_one_of_each_class(spark, spark.createDataFrame(made, SCHEMA).repartition(3), "").collect()


def test_near_copies_between_the_thresholds_go(spark):
    some = random.Random(11)
    vocabulary = [f"w{n}" for n in range(5000)]
    rows = []
    for n, places in ((50, [25]), (100, [30, 70]), (200, [30, 70, 110, 150]), (300, [30, 70, 110, 150, 190, 230])):
        base = some.sample(vocabulary, n)
        rows += [(2 * len(rows), " ".join(base)), (2 * len(rows) + 1, " ".join(edited(base, places)))]
    kept = {r["doc_id"] for r in stage(spark, rows)}
    assert kept == {rows[i][0] for i in (0, 2, 4, 6)} == roots(rows)


def test_the_stage_equals_all_pairs(spark):
    some = random.Random(12)
    vocabulary = [f"w{n}" for n in range(400)]
    texts = ["", "one", "one two", "one two three four", "one two three four five"]
    for n in (4, 5, 6, 9, 20, 30, 45, 50, 60, 100, 240):
        base = some.choices(vocabulary, k=n)
        for _ in range(14):
            made = edited(base, some.sample(range(n), some.choice([0, 1, 1, max(1, n // 50), max(1, n // 25)])))
            texts.append(" ".join(made[: n - some.randint(0, n // 8)]))
    some.shuffle(texts)
    rows = list(enumerate(texts))
    assert {r["doc_id"] for r in stage(spark, rows)} == roots(rows)


def test_repeated_ids_with_other_texts_are_documents_of_their_own(spark):
    some = random.Random(13)
    words = [f"w{n}" for n in range(5000)]
    a, b, c, d, e = (some.sample(words, 80) for _ in range(5))
    text = " ".join
    rows = [(1, text(a)), (5, text(edited(a, [40]))), (5, text(b)), (7, text(c)), (7, text(edited(c, [30])))]
    rows += [(9, text(d)), (9, text(d)), (9, text(edited(a, [50]))), (9, text(e)), (None, text(a)), (None, text(a))]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in stage(spark, rows))
    seven = [r for r in kept if r[0] == 7]
    assert len(seven) == 1 and seven[0] in rows
    without = [r for r in kept if r[0] != 7]
    assert without == sorted([(0, text(a)), (0, text(a)), (1, text(a)), (5, text(b)), (9, text(d)), (9, text(e))])
