"""Exact similarity join of documents by the Jaccard index of their word shingles.

Sets are banded by size into tiles, so that any two that can link lie in one tile together. In a tile
two sets that link differ in at most k shingles; dealt by hash to k + 1 parts, they must agree in one
part at least, so equal parts make candidates without losing any. Among the sets that share a part,
counting the bits of their hashed bitmaps bounds the overlap from above and leaves the pairs that can
link; groups of those are compared by intersecting sorted arrays. Equal sets are compared once.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.components import stars
from vectrail.llm.hashing import mix, word_hashes
from vectrail.scratch import written

#: Bytes of text that are shingled at once, documents of a group that one task compares, and rows or
#: shingles of small groups that share a task.
CHUNK, TILE, SHARED_ROWS, SHARED_SHINGLES = 1 << 18, 1024, 5_000, 500_000
#: Parts of a tile beyond those needed, as a share of these: each set leaves out as many thin ones.
SPARE = 0.25
#: Bits of the bitmap that goes with each set.
BITS = 2048
#: A part that one of so many sets of a sample has is dealt to so many shares first.
HOT_SAMPLE, HOT_SHARE, HOT_SHARES = 4096, 256, 256
#: Bits of the filter of candidates for each of them, and at most: 32 MB.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
_TURN = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        total = mix(total * _TURN[0] + words[j : j + len(total)] * _TURN[1])
    return total


def _long_set(text: bytes, width: int) -> np.ndarray:
    """The set of one long text, made of the sets of stretches of its words."""
    words = word_hashes(text, lower=True)[1]
    if len(words) < width:
        return shingle_sets([text], width, long=len(text))[0]
    parts, held, least = [], 0, CHUNK
    for at in range(0, len(words) - width + 1, CHUNK):
        parts.append(np.unique(_shingles(words[at : at + CHUNK + width - 1], width)))
        held += len(parts[-1])
        # Sets are joined when they have grown to what is there, so repeated shingles take no memory.
        if held >= least:
            parts = [_united(parts)]
            held = len(parts[0])
            least = max(CHUNK, 2 * held)
    del words
    return _united(parts)


def _united(sets: list[np.ndarray]) -> np.ndarray:
    """The union of sets; empties the list, so that no more than two copies are there at once."""
    if len(sets) == 1:
        return sets[0]
    every = np.concatenate(sets)
    sets.clear()
    every.sort()
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


def shingle_sets(texts: list[bytes], width: int = 3, long: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text behind another, and their bounds.

    A-Z is lowered; words are what ASCII white space parts. A text with fewer words than ``width``
    has its whole sequence as one shingle, one without words has none. Texts of more than ``long``
    bytes are taken one by one, in stretches.
    """
    if any(len(t) > long for t in texts):
        sets, sizes, few = [], [], []
        for text in [*texts, None]:
            if text is not None and len(text) <= long:
                few.append(text)
                continue
            if few:
                hashes, bounds = shingle_sets(few, width, long)
                sets.append(hashes)
                sizes.extend(np.diff(bounds))
                few = []
            if text is not None:
                sets.append(_long_set(text, width))
                sizes.append(len(sets[-1]))
        return np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    starts, words = word_hashes(b"\n".join([*texts, b""]), lower=True)
    owner = np.searchsorted(begins, starts, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    total = _shingles(words, width)
    whole = owner[: len(total)] == owner[width - 1 :][: len(total)]
    hashes, owners = total[whole], owner[: len(total)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    first = np.concatenate([[0], np.cumsum(count)])
    if len(short):
        made = []
        for doc in short:
            value = np.array([count[doc]], dtype=np.uint64)
            for word in words[first[doc] : first[doc + 1]]:
                value = mix(value * _TURN[2] + word)
            made.append(value[0])
        hashes = np.concatenate([hashes, np.array(made, dtype=np.uint64)])
        owners = np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(len(texts) + 1))


def size_bands(most: int, percent: int) -> list[tuple[int, int]]:
    """Tiles ``(least size, parts, needed)`` for sets of up to ``most`` shingles: a tile takes the sets
    whose smaller partner has at least that size and less than the next tile's. Of its parts as many
    are needed as two of them can differ in, and one more."""
    tiles, low = [], 1
    while low <= most:
        high = max(low + 1, low * 3 // 2)
        small = high - 1
        both = small + 100 * small // percent
        needed = both * (100 - percent) // (100 + percent) + 1
        tiles.append((low, needed + int(needed * SPARE), needed))
        low = high
    return tiles


def part_keys(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fullest parts of each set, one set behind another, and their bounds.

    Two sets that link agree in all parts but those that they differ in, so in one more than there
    are spare ones. Each set leaves out its spare number of parts, those of fewest shingles, and at
    equal numbers of least key. Of the parts that both agree in the last in this order has all the
    others before it in either set, so neither leaves it out, and no link is lost.
    """
    sizes = np.diff(bounds)
    tiles = size_bands(int(sizes.max(initial=0)), percent)
    lows = np.array([low for low, *_ in tiles] + [1 << 62])
    counts = np.array([parts for _, parts, _ in tiles] + [0])
    needed = np.array([need for *_, need in tiles] + [0])
    own = np.searchsorted(lows, sizes, "right") - 1
    keys, owners = [], []
    # As the smaller one of a pair, and as the larger one of a pair in the tile below.
    below = (own > 0) & (percent * sizes < 100 * lows[own])
    for tile, member in ((own, sizes > 0), (own - 1, below)):
        docs = np.flatnonzero(member)
        if not len(docs):
            continue
        parts = counts[tile[docs]]
        at = np.concatenate([[0], np.cumsum(parts)])
        picked = np.repeat(np.arange(len(docs)), sizes[docs])
        inside = np.arange(len(picked)) - np.repeat(np.cumsum(sizes[docs]) - sizes[docs], sizes[docs])
        values = hashes[bounds[docs][picked] + inside]
        slot = at[picked] + ((values >> np.uint64(20)) % parts[picked].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(at[-1], dtype=np.uint64)
        np.add.at(sums, slot, mix(values ^ _TURN[2]))
        which = np.repeat(np.arange(len(docs)), parts)
        part = np.arange(at[-1]) - at[which]
        place = tile[docs][which].astype(np.uint64) * np.uint64(1 << 32) + part.astype(np.uint64)
        own_keys = mix(sums ^ mix(place))
        order = np.lexsort((own_keys, np.bincount(slot, minlength=at[-1]), which))
        # In this order the parts of a set follow each other, those to leave out first.
        told = np.sort(order[part >= (parts - needed[tile[docs]])[which]])
        keys.append(own_keys[told])
        owners.append(docs[which[told]])
    if not keys:
        return np.array([], dtype=np.uint64), np.zeros(len(sizes) + 1, dtype=np.int64)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.searchsorted(owners[order], np.arange(len(sizes) + 1))


def _chunks(texts: Iterator[bytes | None]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text or b"")
        size += len(chunk[-1])
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _bytes_of(column) -> Iterator[bytes | None]:
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def _by_chunks(docs: DataFrame, schema: str, width: int, columns) -> DataFrame:
    """Rows of ``docs`` with what ``columns`` makes of the shingles of a chunk of texts."""

    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [columns(*shingle_sets(texts, width)) for texts in _chunks(_bytes_of(batch.column(1)))]
            if made:
                arrays = [pa.concat_arrays(parts) for parts in zip(*made)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _set_ids(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit hash of each set; none of an empty one."""
    return [
        hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None
        for a, b in zip(bounds[:-1], bounds[1:])
    ]


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n_shingles, set_id, bitmap)``: equal sets have equal ids, empty ones none."""

    def columns(hashes: np.ndarray, bounds: np.ndarray) -> list:
        import pyarrow as pa

        maps = [row.tobytes() for row in _bitmaps(hashes, bounds, BITS)]
        return [pa.array(np.diff(bounds).astype(np.int64)), pa.array(_set_ids(hashes, bounds), pa.binary()), pa.array(maps, pa.binary())]

    return _by_chunks(docs, "doc_id long, n_shingles long, set_id binary, bitmap binary", width, columns)


def parts_of_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(name, part)`` for each part that a set needs; sets and documents without an id have none.

    Made anew for each use: the keys are as large as the texts, and are worth no disk.
    """

    def columns(hashes: np.ndarray, bounds: np.ndarray) -> list:
        import pyarrow as pa

        keys, ends = part_keys(hashes, bounds, percent)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
        return [pa.array(np.diff(bounds).astype(np.int64)), pa.array(_set_ids(hashes, bounds), pa.binary()), lists]

    named = docs.where(F.col("doc_id").cast("long").isNotNull())
    made = _by_chunks(named, "doc_id long, n_shingles long, set_id binary, keys array<long>", width, columns)
    return made.where("set_id is not null").select(_name(), F.explode("keys").alias("part"))


def _name() -> Column:
    """A set is named by 64 bits of its id; if two meet in one name, they become candidates."""
    return F.xxhash64("set_id").alias("name")


def _hot_parts(docs: DataFrame, rows: int, width: int, percent: int) -> DataFrame:
    """Parts that one of HOT_SHARE sets has or more, by a sample of about HOT_SAMPLE documents.

    Their number is bounded by the sample: its keys over HOT_SAMPLE / HOT_SHARE.
    """
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(1, rows // HOT_SAMPLE)))
    some = parts_of_sets(docs.where(share == 0), width, percent).distinct()
    return some.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_SAMPLE // HOT_SHARE).select("part")


def _groups(docs: DataFrame, rows: int, width: int, percent: int) -> DataFrame:
    """``(group, name)`` of the sets that share a part; parts that the same sets share make one group."""
    hot = _hot_parts(docs, rows, width, percent).withColumn("hot", F.lit(True))
    keyed = parts_of_sets(docs, width, percent).join(F.broadcast(written(hot, "hot-parts")), "part", "left")
    # The sets of a hot part are told apart in many shares first.
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("name", F.lit(7)), F.lit(HOT_SHARES))).otherwise(0)
    same = Window.partitionBy("part", "share")
    figures = {
        "least": F.min("name"),
        "most": F.max("name"),
        "one": F.sum(F.hash("name").cast("long")),
        "two": F.sum(F.hash("name", F.lit(2)).cast("long")),
    }
    counted = keyed.withColumn("share", share)
    for name in ("least", "most"):
        counted = counted.withColumn(name, figures[name].over(same))
    counted = counted.where("least <> most or hot")
    for name in ("one", "two"):
        counted = counted.withColumn(name, figures[name].over(same))
    group = F.xxhash64(*figures).alias("group")
    shared = written(counted.select("part", "hot", "name", *figures), "shared-parts")
    hot_rows = shared.where("hot").select("part", "name").distinct()
    merged = hot_rows.groupBy("part").agg(*(f.alias(n) for n, f in figures.items())).where("least <> most")
    # As many rows as there are hot parts.
    several = hot_rows.join(F.broadcast(merged), "part").select(group, "name")
    return shared.where("hot is null").select(group, "name").unionByName(several).distinct()


def _names_in(names: DataFrame, count: int):
    """A test of names for being among some: a bloom filter, which lets through a few others.

    It has FILTER_BITS bits for each name, in a power of two up to MOST_FILTER_BITS; beyond that it
    lets more through and still loses none.
    """
    bits = 1 << min(max(10, (count * FILTER_BITS).bit_length()), MOST_FILTER_BITS.bit_length() - 1)
    places = F.transform(
        F.array(*(F.lit(i) for i in range(4))), lambda i: F.pmod(F.xxhash64(F.col("name"), i), F.lit(bits))
    )
    words = names.select(F.explode(places).alias("place")).select(
        F.shiftright("place", 6).cast("long").alias("word"),
        F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"),
    )
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = names.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        rows = np.stack(at.to_numpy())
        return pd.Series(((shared.value[rows >> 6] >> (rows & 63)) & 1).all(axis=1))

    return known(places)


def _bitmaps(hashes: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """A row of bits for each set, packed into 64-bit words."""
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    flags = np.zeros((n, bits), dtype=np.uint8)
    flags[rows, (hashes % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags, axis=1).view(np.uint64)


def linked_roots(
    sizes: np.ndarray,
    maps: np.ndarray,
    percent: int,
    hashes: np.ndarray | None = None,
    bounds: np.ndarray | None = None,
) -> np.ndarray:
    """For each set the first set that it reaches over links, by a search that compares a set only
    with those that no link has reached yet. Without ``hashes`` two sets link if their bitmaps do
    not rule it out."""
    root, left = np.full(len(sizes), -1), np.arange(len(sizes))
    for first in range(len(sizes)):
        if root[first] >= 0:
            continue
        root[first] = first
        left = left[left != first]
        queue = [first]
        while queue and len(left):
            one = queue.pop()
            a, b = sizes[one], sizes[left]
            near = left[(np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)]
            if not len(near):
                continue
            b = sizes[near]
            # Each bit that only one has stands for a shingle at least that the other lacks.
            only_a = np.bitwise_count(maps[one] & ~maps[near]).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(~maps[one] & maps[near]).sum(axis=1, dtype=np.int64)
            most = np.minimum(a - only_a, b - only_b)
            found = near[most * 100 >= (a + b - most) * percent]
            if hashes is not None and len(found):
                mine = hashes[bounds[one] : bounds[one + 1]]
                theirs = np.concatenate([hashes[bounds[i] : bounds[i + 1]] for i in found])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                begin = np.concatenate([[0], np.cumsum(sizes[found])[:-1]])
                common = np.add.reduceat(hit.astype(np.int64), begin)
                found = found[common * 100 >= (a + sizes[found] - common) * percent]
            if len(found):
                root[found] = first
                queue.extend(found.tolist())
                left = left[root[left] < 0]
    return root


def _dealt(rows: DataFrame, tile: int, tasks: int) -> DataFrame:
    """Rows with a ``group`` and a ``name`` to tasks ``(task, low, high)``: small groups share one, of
    a group larger than ``tile`` each two blocks meet in one of their own."""
    large = rows.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") > tile)
    blocks = F.coalesce(2 * F.ceil(F.col("size") / tile), F.lit(1)).cast("int")
    cut = (
        rows.join(large, "group", "left")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or block <> with")
    )
    alone = F.col("blocks") == 1
    return cut.select(
        *rows.columns,
        F.when(alone, F.pmod("group", F.lit(max(1, tasks)))).otherwise(F.col("group")).alias("task"),
        F.when(alone, -1).otherwise(F.least("block", "with")).alias("low"),
        F.when(alone, -1).otherwise(F.greatest("block", "with")).alias("high"),
    )


def _links_in_groups(rows: pd.DataFrame, roots_of) -> pd.DataFrame:
    """Links of the rows of each group to the first one that they reach, by ``roots_of`` the rows."""
    rows = rows.sort_values(["group", "name"], ignore_index=True)
    group, name = rows["group"].to_numpy(), rows["name"].to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    a, b = [], []
    for first, last in zip(edges[:-1], edges[1:]):
        if last - first > 1:
            root = roots_of(rows.iloc[first:last])
            moved = np.flatnonzero(root != np.arange(len(root)))
            a.append(name[first:last][moved])
            b.append(name[first:last][root[moved]])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)} if a else {"a": [], "b": []})


def similarity_classes(
    docs: DataFrame, width: int = 3, percent: int = 90, tile: int = TILE
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Two documents link when 100 times their common shingles reach ``percent`` times their union.
    ``component_id`` is the smallest doc_id that links reach. Documents without words, or with a null text,
    have no shingles and link with nothing. Rows with a null doc_id link with nothing and have a null
    component. Repeated ids are taken as documents of their own that share an id. Other columns
    are ignored; an empty table gives an empty one.

    Candidate groups larger than ``tile`` are cut into blocks and each pair of blocks is searched
    in a task of its own, so no task holds a whole group.
    """
    sets = written(shingled(docs, width), "shingle-sets")
    usable = sets.where(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    firsts = written(
        usable.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n")), "first-copies"
    )
    name = _name()
    sharing = written(_groups(docs, sets.count(), width, percent), "sharing")
    tasks = sharing.count() // SHARED_ROWS
    maps = usable.join(firsts, "set_id").where("doc_id = first").select(name, "n_shingles", "bitmap")

    def bounded(rows: pd.DataFrame) -> pd.DataFrame:
        def roots(some: pd.DataFrame) -> np.ndarray:
            maps = np.frombuffer(b"".join(some["bitmap"]), dtype=np.uint64).reshape(len(some), -1)
            return linked_roots(some["n_shingles"].to_numpy(), maps, percent)

        return _links_in_groups(rows, roots)

    mapped = _dealt(sharing, tile, tasks).join(maps.dropDuplicates(["name"]), "name")
    near = mapped.groupBy("task", "low", "high").applyInPandas(bounded, "a long, b long")
    groups = stars(near)
    both = groups.select(F.col("node").alias("name"), F.col("component_id").alias("group"))
    heads = both.select(F.col("group").alias("name"), "group").distinct()
    candidates = written(
        firsts.select(name, F.col("first").alias("doc_id"), "n")
        .join(both.unionByName(heads), "name")
        .select(F.col("doc_id").alias("name"), "group", "n"),
        "candidates",
    )
    count, weight = candidates.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = _dealt(candidates.drop("n"), tile, weight // SHARED_SHINGLES)
    texts = docs.select(F.col("doc_id").cast("long").alias("name"), F.col("text").cast("binary").alias("text"))
    # Candidates grow with the table, so they are never broadcast; a filter of fixed size is, and texts
    # that it knows not to be candidates stay where they are.
    likely = texts.where("name is not null").where(_names_in(candidates.select("name"), count))
    met = likely.join(placed.hint("merge"), "name").groupBy("task", "low", "high")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        # A repeated id may bring another text; each row is compared, and the id stands for all.
        def roots(some: pd.DataFrame) -> np.ndarray:
            parts = [shingle_sets(c, width) for c in _chunks(some["text"])]
            hashes = np.concatenate([h for h, _ in parts])
            sizes = np.concatenate([np.diff(b) for _, b in parts])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            bits = 1 << min(max(8, int(sizes.max(initial=1)).bit_length()), 14)
            return linked_roots(sizes, _bitmaps(hashes, bounds, bits), percent, hashes, bounds)

        return _links_in_groups(rows, roots)

    links = stars(met.applyInPandas(compare, "a long, b long"))
    members = usable.select("doc_id", "set_id").join(firsts.select("set_id", "first"), "set_id")
    known = members.join(links.withColumnRenamed("node", "first"), "first", "left").select(
        "doc_id", "set_id", F.coalesce("component_id", "first").alias("component_id")
    )
    found = sets.select("doc_id", "set_id", "n_shingles").join(known.dropDuplicates(["doc_id", "set_id"]), ["doc_id", "set_id"], "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
