"""Nearest neighbours by an adaptive scan of dimensions.

Vectors are assigned to lists by the nearest of learned centres and are rotated at random, so that
every block of columns holds a fair share of a distance. Within a probed list, distances grow column
block by column block; after each block a hypothesis test abandons the candidates whose partial
distance, scaled up, can hardly stay below the query's tenth best. What is left is ranked by its
exact distance on the original vectors.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.vectors import matrix, one_vector_per_key, pack_usable, sample_matrix, usable_dimension
from vectrail.scratch import written

#: Vectors and queries of a list that meet in one task.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
SAMPLE = 20_000
MOST_LISTS = 2500


def learn_centres(sample: np.ndarray, lists: int, steps: int = 8, seed: int = 1) -> np.ndarray:
    """Centres of ``lists`` lists by Lloyd's iterations."""
    random = np.random.default_rng(seed)
    centres = sample[random.permutation(len(sample))[:lists]].copy()
    for _ in range(steps):
        near = _nearest(sample, centres, 1)[:, 0]
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), dtype=np.int64)
    for at in range(0, len(x), 1024):
        far = (centres * centres).sum(axis=1) - 2 * x[at : at + 1024] @ centres.T
        out[at : at + 1024] = np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def needed_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """How many lists must be probed to find the share ``recall`` of the k nearest of sampled rows
    among the sample: neighbours in a sparser sample lie further away, so the table needs no more."""
    lists = _nearest(sample, centres, 1)[:, 0]
    queries = sample[:asked]
    places = np.argsort(_nearest(queries, centres, len(centres)), axis=1)
    norms = (sample * sample).sum(axis=1)
    needed = []
    for i, query in enumerate(queries):
        far = norms - 2 * sample @ query
        far[i] = np.inf
        needed.append(places[i, lists[np.argsort(far, kind="stable")[:k]]])
    return int(np.quantile(np.concatenate(needed), recall)) + 1


def scan(
    queries: np.ndarray,
    vectors: np.ndarray,
    bounds: np.ndarray,
    k: int,
    block: int = 16,
    doubt: float = 2.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of queries and of vectors that pass the tests of an adaptive scan.

    Both are rotated; ``bounds`` are squared distances that the k nearest do not exceed. A partial
    squared distance over d of D columns stands for D / d of it; a candidate goes if that exceeds
    the bound by more than a factor (1 + doubt / sqrt(d))^2, which is rare for one that is nearer.
    """
    dimension = vectors.shape[1]
    found_q, found_v = [], []
    for q in range(len(queries)):
        alive = np.arange(len(vectors))
        partial = np.zeros(len(vectors))
        bound = bounds[q]
        for first in range(0, dimension, block):
            last = min(first + block, dimension)
            gap = vectors[alive, first:last] - queries[q, first:last]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            if last < dimension:
                limit = bound * (1 + doubt / math.sqrt(last)) ** 2 * last / dimension
                stays = partial <= limit
                alive, partial = alive[stays], partial[stays]
            if first == 0 and len(alive) > k:
                # The whole distance of the k that look nearest now bounds the k-th of this list.
                likely = alive[np.argpartition(partial, k - 1)[:k]]
                gap = vectors[likely] - queries[q]
                bound = min(bound, np.einsum("ij,ij->i", gap, gap).max())
        if len(alive) > k:
            # Rounding of the rotation must not part ties, so near ones stay for the exact ranking.
            alive = alive[partial <= np.partition(partial, k - 1)[k - 1] * (1 + 1e-9) + 1e-12]
        found_q.append(np.full(len(alive), q))
        found_v.append(alive)
    return np.concatenate(found_q), np.concatenate(found_v)


def search(
    rows: DataFrame,
    is_query,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    recall: float = 0.97,
    sample: int = SAMPLE,
    seed: int = 1,
) -> DataFrame:
    """``(query_id, rank, key, score)``: the k nearest found of every row that the condition
    ``is_query`` selects, among all other rows, by Euclidean distance on the original vectors.

    Ties go to the smaller key. Vectors that are null, zero, of another dimension than most, or
    hold null or non-finite components take no part; neither do rows with a null key. Of a
    repeated key the vector of least bytes stands for all its rows. A query probes as many of the nearest lists as :func:`needed_probes` finds on the
    sample for ``recall``, and more if they hold fewer than k other vectors. Centres are learned on at most ``sample`` vectors; every vector is in a list.
    A list that holds many vectors or queries is cut into blocks that meet in tasks of their own.
    """
    spark = rows.sparkSession
    dimension = usable_dimension(rows, vector)
    usable = one_vector_per_key(pack_usable(rows, key, vector, dimension).withColumnRenamed(key, "key"))
    n = usable.count()
    ids, seen = sample_matrix(usable, "key", sample, dimension, seed)
    lists = min(max(1, round(math.sqrt(n))), MOST_LISTS, max(1, len(seen)))
    if not n:
        kind = f"query_id long, rank int, {key} long, score double"
        return spark.createDataFrame([], kind)
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.normal(size=(dimension, dimension)))[0]
    # At most MOST_LISTS centres and a thousand sampled vectors, whatever the table.
    centres = learn_centres(seen, lists, seed=seed)
    probes = needed_probes(seen, centres, k, recall) if len(seen) > 1 else 1
    index = spark.sparkContext.broadcast((centres, ids[:1000], seen[:1000], rotation))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = _nearest(matrix(batch["packed"], dimension), index.value[0], 1)
            yield batch.assign(list=near[:, 0])

    listed = written(usable.mapInPandas(assign, "key long, packed binary, list long"), "lists")
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(lists)])
    filled = spark.sparkContext.broadcast(held)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, some_ids, some, _ = index.value
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["packed"], dimension)
            order = _nearest(x, centres, len(centres))
            reach = np.cumsum(filled.value[order], axis=1)
            # Enough lists to hold k vectors beside the query itself.
            enough = (reach < k + 1).sum(axis=1) + 1
            take = np.minimum(np.maximum(enough, probes), len(centres))
            bounds = np.full(len(x), np.inf)
            for i, query in enumerate(x):
                gaps = np.sort(((some - query) ** 2).sum(axis=1)[some_ids != batch["key"].iloc[i]])
                if len(gaps) >= k:
                    bounds[i] = gaps[k - 1] * (1 + 1e-9) + 1e-12
            repeat = np.repeat(np.arange(len(x)), take)
            probed = np.concatenate([order[i, :t] for i, t in enumerate(take)])
            yield pd.DataFrame(
                {
                    "key": batch["key"].to_numpy()[repeat],
                    "packed": batch["packed"].to_numpy()[repeat],
                    "list": probed,
                    "bound": bounds[repeat],
                }
            )

    asked = listed.where(is_query(F.col("key"))).select("key", "packed")
    probing = written(asked.mapInPandas(probe, "key long, packed binary, list long, bound double"), "probes")
    counts = probing.groupBy("list").agg(F.count("*").alias("queries")).collect()
    blocks_v = np.maximum(1, -(-held // VECTOR_BLOCK))
    blocks_q = np.ones(lists, dtype=np.int64)
    for r in counts:
        blocks_q[r["list"]] = -(-r["queries"] // QUERY_BLOCK)
    # One number a list.
    shape = spark.createDataFrame(
        pd.DataFrame({"list": np.arange(lists), "bv": blocks_v, "bq": blocks_q}), "list long, bv long, bq long"
    )

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        with_shape = side.join(F.broadcast(shape), "list")
        return with_shape.withColumn(mine, F.pmod(F.xxhash64("key"), F.col(own)).cast("long")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        )

    keys = ["list", "v", "q"]
    left = dealt(probing, "bq", "bv", "q", "v").select("key", "packed", "bound", *keys)
    right = dealt(listed, "bv", "bq", "v", "q").select("key", "packed", *keys)

    def meet(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "key": [], "score": []})
        rotation = index.value[3]
        vectors = vectors.sort_values("key")
        x, y = matrix(queries["packed"], dimension), matrix(vectors["packed"], dimension)
        q_ids, v_ids = queries["key"].to_numpy(), vectors["key"].to_numpy()
        # One more than k, as the query itself is in one of its lists.
        q, v = scan(x @ rotation, y @ rotation, queries["bound"].to_numpy(), k + 1)
        other = q_ids[q] != v_ids[v]
        q, v = q[other], v[other]
        score = np.sqrt(((x[q] - y[v]) ** 2).sum(axis=1))
        order = np.lexsort((v_ids[v], score, q))
        q, v, score = q[order], v[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < k
        return pd.DataFrame({"query_id": q_ids[q[kept]], "key": v_ids[v[kept]], "score": score[kept]})

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    hits = met.applyInPandas(meet, "query_id long, key long, score double")
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "key"))
    return (
        hits.withColumn("rank", nearest)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("key").alias(key), "score")
    )
