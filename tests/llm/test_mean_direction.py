"""Near-duplicates of vectors that share a mean direction, at the default share of found links."""

import math

import numpy as np
import pytest

from tests.llm.test_vectors import brute_links, table
from vectrail.llm import itq_dedup


def leaning(seed, pairs, dimension, mean, spread=0.0):
    """Unit vectors with a common mean part of about ``mean``, in pairs of cosine 0.9 with equal mean parts."""
    some = np.random.default_rng(seed)
    part = np.clip(mean + spread * some.normal(size=pairs), 0, 0.97)
    side = np.sqrt(1 - part**2)
    turn = 1 - 0.0999 / side**2
    u, v = some.normal(size=(2, pairs, dimension - 1))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(axis=1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = turn[:, None] * u + np.sqrt(np.maximum(0, 1 - turn**2))[:, None] * v
    ends = [np.column_stack([part, side[:, None] * x]) for x in (u, w)]
    return ends[0], ends[1]


@pytest.mark.parametrize("mean, spread", [(0.0, 0.0), (0.5, 0.0), (0.7, 0.05), (0.8, 0.0), (0.8, 0.05)])
def test_tables_find_links_about_a_mean(mean, spread):
    a, b = leaning(6, 3000, 64, mean, spread)
    both = np.concatenate([a, b])
    far = np.linalg.norm(both - both.mean(axis=0), axis=1)
    bits, tables, core = itq_dedup.table_shape(50_000, 0.9, 0.97, far)
    middle, rotations = itq_dedup.learn_rotations(both, -(-bits * tables // 64), steps=5)
    codes = ((both - middle) @ rotations)[:, : bits * tables] >= 0
    codes = codes.reshape(2, len(a), tables, bits)
    met = (codes[0] == codes[1]).all(axis=2).any(axis=1)
    met |= (far.reshape(2, -1) <= core).all(axis=0)
    assert met.mean() >= 0.955, (bits, tables, core)


def test_the_widest_angle_bounds_all_links():
    some = np.random.default_rng(7)
    for least, outer in ((0.6, 0.6), (0.5, 0.7), (0.3, 0.9), (0.0, 0.5), (0.1, 0.4)):
        ra, rb = some.uniform(outer, 1.5, 20_000), some.uniform(max(least, 1e-6), 1.5, 20_000)
        cosine = (ra**2 + rb**2 - some.uniform(0, 0.2, 20_000)) / (2 * ra * rb)
        angles = np.arccos(cosine[np.abs(cosine) <= 1])
        assert angles.max() <= itq_dedup.widest_angle(least, outer, 0.9) + 1e-9
    assert math.isclose(itq_dedup.widest_angle(1, 1, 0.9), math.acos(0.9))


@pytest.mark.parametrize("cost", [itq_dedup.COPY_COST, 1])
def test_links_with_a_mean_of_four_fifths(spark, monkeypatch, cost):
    monkeypatch.setattr(itq_dedup, "TILE", 200)
    monkeypatch.setattr(itq_dedup, "COPY_COST", cost)
    a, b = leaning(8, 900, 16, 0.8, 0.04)
    made = np.concatenate([a, b]).astype(np.float32)
    rows = {r["vec_id"]: r for r in itq_dedup.near_duplicates(table(spark, made)).collect()}
    links, _ = brute_links(made)
    got = np.array([rows[i]["n_links"] for i in range(len(made))])
    assert (got <= links).all() and got.sum() >= 0.965 * links.sum()
