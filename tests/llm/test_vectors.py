"""Vector search and near-duplicates against brute force."""

import numpy as np
import pytest

from vectrail.llm import ann_scan, itq_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score string"
BAD = [(90_000, None), (90_100, [0.0] * 16), (90_001, [float("nan")] * 16), (90_200, [1.0, None] * 8), (90_002, [1.0] * 5), (90_300, [float("inf")] + [1.0] * 15)]


def table(spark, vectors, first=0):
    rows = [(first + i, v.astype(float).tolist(), 1, "k", "s") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows + [(i, v, 1, "k", "s") for i, v in BAD], SCHEMA)


def clusters(seed, n):
    some = np.random.default_rng(seed)
    centres = some.normal(size=(12, 16))
    made = centres[some.integers(0, 12, n)] + some.normal(size=(n, 16)) * some.choice([0.02, 0.1, 0.4], (n, 1))
    made[n // 2 : n // 2 + 20] = made[0]  # equal vectors
    return made.astype(np.float32)


def test_search_finds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann_scan, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(ann_scan, "QUERY_BLOCK", 3)
    made = clusters(1, 1500)
    found = ann_scan.search(table(spark, made), lambda key: key % 100 == 0).collect()
    x, by_query = made.astype(float), {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(by_query) == list(range(0, 1500, 100))
    hits = 0
    for q, rows in by_query.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(len(x)), far))[:10]
        assert [r[0] for r in sorted(rows)] == list(range(1, 11))
        assert [(s, v) for _, s, v in sorted(rows)] == sorted((s, v) for _, s, v in rows)
        assert all(abs(s - far[v]) < 1e-12 for _, s, v in rows)
        hits += len(set(best) & {v for *_, v in rows})
    assert hits >= 0.95 * 10 * len(by_query)


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_search_returns_all_candidates_of_small_tables(spark, n):
    found = ann_scan.search(table(spark, clusters(2, 60)[:n]), lambda key: key % 100 == 0)
    assert found.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    assert sorted(r["vec_id"] for r in found.collect()) == list(range(1, n))


def test_a_scan_keeps_the_nearest():
    some = np.random.default_rng(3)
    vectors, queries = some.normal(size=(2000, 64)), some.normal(size=(20, 64))
    q, v = ann_scan.scan(queries, vectors, np.full(20, np.inf), 10)
    assert len(q) < 20 * 2000 / 10
    hits = 0
    for i in range(20):
        best = np.argsort(((vectors - queries[i]) ** 2).sum(axis=1))[:10]
        hits += len(set(best) & set(v[q == i]))
    assert hits >= 195


def brute_links(made, threshold=0.9):
    x = made.astype(float)
    norm = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / norm[:, None] / norm[None] >= threshold
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        low = np.array([min([root[i], *root[linked[i]]]) for i in range(len(x))])
        if (low == root).all():
            return linked.sum(axis=1), root
        root = low


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(itq_dedup, "TILE", 40)
    made = clusters(4, 700)
    rows = {r["vec_id"]: r for r in itq_dedup.near_duplicates(table(spark, made), found=0.9999).collect()}
    assert len(rows) == 700 + len(BAD)
    links, root = brute_links(made)
    assert links.sum() > 5000
    got = np.array([rows[i]["n_links"] for i in range(700)])
    assert (got <= links).all() and got.sum() >= 0.995 * links.sum()
    assert [rows[i]["component_id"] for i in range(700)] == root.tolist()
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] for i, _ in BAD)


def test_near_duplicates_of_few_rows(spark):
    assert itq_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert itq_dedup.near_duplicates(table(spark, [])).count() == len(BAD)
    rows = itq_dedup.near_duplicates(table(spark, np.ones((3, 16)))).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in rows[:3]] == [(2, 0)] * 3


def test_repeated_ids_have_one_vector(spark):
    made = np.random.default_rng(8).normal(size=(40, 6)).astype(np.float32)
    rows = [(i, made[i].tolist(), 1, "k", "s") for i in range(40)]
    # Every second id comes twice with the same vector, 0 and 4 with another one, too.
    more = [rows[i] for i in range(0, 40, 2)] + [(0, (-made[0]).tolist(), 1, "k", "s"), (4, made[5].tolist(), 1, "k", "s")]
    chosen = {i: min(v.tobytes() for v in ([made[i], -made[0]] if i == 0 else [made[4], made[5]] if i == 4 else [made[i]])) for i in range(40)}
    vectors = {i: np.frombuffer(b, np.float32).astype(float) for i, b in chosen.items()}
    df = spark.createDataFrame(rows + more, SCHEMA)
    found = {}
    for r in ann_scan.search(df.repartition(3), lambda key: key % 10 == 0, recall=1.0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for query in (0, 10, 20, 30):
        order = sorted((np.sqrt(((vectors[query] - vectors[i]) ** 2).sum()), i) for i in range(40) if i != query)
        assert sorted(found[query]) == [(n, i) for n, (_, i) in enumerate(order[:10], 1)]
    near = [tuple(r) for r in itq_dedup.near_duplicates(df).collect()]
    assert len(near) == 62 and sorted(near) == sorted(tuple(r) for r in itq_dedup.near_duplicates(df.repartition(5)).collect())
    links = {i: n for i, n, *_ in near}
    same = chosen[4] == chosen[5]
    assert links[4] == links[5] == int(same) and links[0] == 0 and len(set(near)) == 40
