"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation learned on a sample turns vectors into balanced binary codes. Several rotations give long
codes, whose pieces of equal length are the keys of as many tables. Vectors that share a key in any
table are compared with their original values. The pieces are as long as the number of vectors asks
for, and there are as many tables as links at the threshold itself need to be found with the wanted
probability, since an angle flips each bit with probability angle / pi. Codes are taken about the mean,
which widens angles the more, the nearer vectors are to it: the widest angle of a link sets the number
of tables, and vectors so near to the mean that this would ask for too many are compared with each other
in a table of their own.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.components import stars
from vectrail.llm.vectors import matrix, one_vector_per_key, pack_usable, sample_matrix, usable_dimension
from vectrail.scratch import written

#: Vectors of one key that one task compares; keys with more are cut into tiles.
TILE = 1024
SAMPLE = 20_000
#: What a copy of a vector in one more table costs, in comparisons of two vectors.
COPY_COST = 500


def learn_rotations(sample: np.ndarray, count: int, steps: int = 30, seed: int = 5) -> tuple:
    """The mean and ``count`` learned rotations, each from another random start."""
    dimension = sample.shape[1]
    random = np.random.default_rng(seed)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dimension)
    centred, rotations = sample - mean, []
    for _ in range(count):
        rotation = np.linalg.qr(random.normal(size=(dimension, dimension)))[0]
        for _ in range(steps if len(sample) > 1 else 0):
            codes = np.where(centred @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ centred)
            rotation = (left @ right).T
        rotations.append(rotation)
    return mean, np.concatenate(rotations, axis=1)


def widest_angle(least: float, outer: float, threshold: float) -> float:
    """The widest angle about the mean between the ends of a link, one at least ``least`` and the other
    at least ``outer`` from it, in unit vectors with at least the cosine ``threshold``."""
    gap = 2 - 2 * threshold
    if least <= 0:
        return math.asin(min(1.0, math.sqrt(gap) / outer)) if outer * outer > gap else math.pi
    near = min(max(math.sqrt(max(outer * outer - gap, 0.0)), least), outer)
    return math.acos(min(1.0, max(-1.0, (outer * outer + near * near - gap) / (2 * outer * near))))


def table_shape(vectors: int, threshold: float, found: float, far: np.ndarray) -> tuple[int, int, float]:
    """Bits of a key, number of tables and radius of the core: about ten vectors share a key, and a
    link at the threshold shares one of its keys with probability ``found``, or has both ends in the
    core, whose vectors are all compared. ``far`` are distances of sampled unit vectors from the mean.
    Of all radii the one that makes the least work is taken; it is negative without a core."""
    bits = min(30, max(8, math.ceil(math.log2(max(vectors, 2))) - 4))
    if not len(far):
        return bits, 1, -1.0
    least, most = float(far.min()), float(far.max())
    # A core of all needs no other table.
    best = (COPY_COST * math.ceil(vectors / TILE) + vectors, 1, math.inf)
    for outer in np.quantile(far, [0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9]).tolist():
        core = outer > least
        alike = (1 - widest_angle(least, outer, threshold) / math.pi) ** bits if outer > 0 else 0.0
        if alike <= 0 or (core and outer >= most):
            continue
        tables = max(1, math.ceil(math.log(1 - found) / math.log1p(-alike))) if alike < 1 else 1
        share = float((far <= outer).mean()) if core else 0.0
        copies = tables + share * math.ceil(share * vectors / TILE)
        work = COPY_COST * copies + vectors * (share * share + tables / 2**bits)
        best = min(best, (work, tables, outer if core else -1.0))
    return bits, best[1], best[2]


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(table: int, own: pd.DataFrame, other: pd.DataFrame | None, dimension: int, threshold: float) -> list:
    """Links within ``own``, or between it and ``other``: ids, links and weights of both ends."""
    x = matrix(own["packed"], dimension)
    y = x if other is None else matrix(other["packed"], dimension)
    cosine = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None]
    i, j = np.nonzero(cosine >= threshold)
    if other is None:
        i, j, other = i[i < j], j[i < j], own
    if not len(i):
        return []
    # A link counts in the first table where both have the same key, and nowhere else.
    mine, theirs = np.array(own["keys"].tolist()), np.array(other["keys"].tolist())
    first = (mine[i, :table] != theirs[j, :table]).all(axis=1) if table else np.ones(len(i), bool)
    a, b = own["key"].to_numpy(), other["key"].to_numpy()
    m, n = own["copies"].to_numpy(), other["copies"].to_numpy()
    return [(a[i], b[j], np.where(first, n[j], 0), np.where(first, m[i], 0))]


def near_duplicates(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    found: float = 0.97,
    sample: int = SAMPLE,
    seed: int = 5,
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per row of ``rows`` with a non-null key.

    Links join vectors whose cosine in double precision is at least ``threshold``; a link at the
    threshold is found with probability ``found``, nearer ones more surely, and none below it is
    made. Vectors that are null, zero, of another dimension than most, or hold null or non-finite
    components link with nothing. Equal vectors are compared once and count as often as they are
    there; of a repeated key the vector of least bytes stands for all its rows. Other columns
    are ignored. Rotations are learned on at most ``sample`` vectors; all vectors are in the tables.
    """
    spark = rows.sparkSession
    given = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    dimension = usable_dimension(given, "v")
    usable = one_vector_per_key(pack_usable(given, "key", "v", dimension))
    groups = written(
        usable.groupBy("packed").agg(F.min("key").alias("key"), F.count("*").alias("copies")), "distinct-vectors"
    )
    n = groups.count()
    _, seen = sample_matrix(groups, "key", sample, dimension, seed)
    seen /= np.linalg.norm(seen, axis=1, keepdims=True) if len(seen) else 1.0
    far = np.linalg.norm(seen - seen.mean(axis=0), axis=1) if len(seen) else np.zeros(0)
    bits, tables, core = table_shape(n, threshold, found, far)
    count = -(-bits * tables // max(dimension, 1))
    # Of fixed size for a dimension and a number of tables.
    learned = spark.sparkContext.broadcast(learn_rotations(seen, count, seed=seed))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, rotations = learned.value
        places = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            x = matrix(batch["packed"], dimension)
            x /= np.linalg.norm(x, axis=1, keepdims=True) if len(x) else 1.0
            x -= mean
            code = (x @ rotations)[:, : bits * tables] >= 0
            keys = code.reshape(len(x), tables, bits) @ places
            if core >= 0:
                # The last table has one key, for the core; the others have none there.
                inside = np.where(np.linalg.norm(x, axis=1) <= core, 0, -1)
                keys = np.concatenate([keys, inside[:, None]], axis=1)
            yield batch.assign(keys=list(keys.astype(np.int32)))

    coded = written(
        groups.mapInPandas(encode, "packed binary, key long, copies long, keys array<int>"), "codes"
    )
    placed = coded.select("key", "copies", "packed", "keys", F.posexplode("keys").alias("table", "at"))
    placed = placed.where("at >= 0")
    sizes = coded.select(F.posexplode("keys").alias("table", "at")).where("at >= 0").groupBy("table", "at")
    large = sizes.agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    chunks = max(1, n // TILE)
    tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    cut = placed.join(large, ["table", "at"], "left").withColumn("tiles", tiles)
    cut = cut.withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    # Keys with few vectors share a group, and a tile of a large key is a group of its own.
    dealt = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key",
        "copies",
        "packed",
        "keys",
        "table",
        "at",
        "tile",
        F.when(F.col("tiles") == 1, F.pmod("at", F.lit(chunks)) + F.lit(1 << 31)).otherwise(F.col("at")).alias("group"),
        F.least("tile", "with").alias("low"),
        F.greatest("tile", "with").alias("high"),
    )

    def link(group: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        table, _, low, high = (int(x) for x in group)
        batch = batch.sort_values(["at", "key"], ignore_index=True)
        links = []
        if low != high:
            own, other = batch[batch["tile"] == low], batch[batch["tile"] == high]
            if len(own) and len(other):
                links = _compare(table, own, other, dimension, threshold)
        else:
            at = batch["at"].to_numpy()
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
            for first, last in zip(edges[:-1], edges[1:]):
                if last - first > 1:
                    links += _compare(table, batch.iloc[first:last], None, dimension, threshold)
        if not links:
            return pd.DataFrame({"key": [], "root": [], "links": []})
        a, b, for_a, for_b = (np.concatenate(x) for x in zip(*links))
        nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        total = np.bincount(back, np.concatenate([for_a, for_b]), len(nodes)).astype(np.int64)
        roots = _local_roots(back[: len(a)], back[len(a) :], len(nodes))
        return pd.DataFrame({"key": nodes, "root": nodes[roots], "links": total})

    grouped = dealt.groupBy("table", "group", "low", "high")
    linked = written(grouped.applyInPandas(link, "key long, root long, links long"), "links")
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    roots = stars(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    classes = (
        groups.join(links, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select(
            "packed",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "key").alias("component_id"),
        )
    )
    members = usable.join(classes, "packed").select("key", "n_links", "component_id")
    whole = given.select("key").join(members, "key", "left")
    component = F.coalesce("component_id", "key")
    return whole.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("key")).alias("kept"),
    )
