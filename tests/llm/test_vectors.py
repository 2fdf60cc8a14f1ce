import math
import random

import numpy as np
import pytest

from ledgerloom.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, h string, rep string"


def brute(rows, threshold=0.98):
    ok = lambda r: r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    n, ids = len(rows), [r[0] for r in rows]
    vec = [np.array(r[1], np.float32).astype(float) if ok(r) else None for r in rows]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and vec[i] is not None and vec[j] is not None and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]):
                if vec[i] @ vec[j] / math.sqrt(vec[i] @ vec[i]) / math.sqrt(vec[j] @ vec[j]) >= threshold:
                    links[i].append(j)
    low = dict(zip(range(n), ids))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                low[i] = low[j] = min(low[i], low[j])
    return sorted(((ids[i], len(links[i]), low[i], ids[i] is not None and ids[i] == low[i]) for i in range(n)), key=str)


@pytest.mark.parametrize("tile", [7, 1024])
def test_against_brute_force(spark, tile):
    rng = random.Random(tile)
    rows, k = [], 0
    for c in range(14):
        base = [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(rng.randint(1, 9)):
            noise = rng.choice([0.0, 0.02, 0.12, 0.16])
            rows.append((k, [x + rng.gauss(0, noise) for x in base], c % 3))
            k += 1
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, [2 * x for x in rows[0][1]], 0), (503, None, 0), (504, [0.0] * 16, 0), (505, [None] + [1.0] * 15, 0),
             (506, [float("nan")] * 16, 0), (507, [float("inf")] + [1.0] * 15, 0), (508, rows[0][1], None), (509, rows[0][1][:5], 0), (510, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in V.near_vectors(df, tile=tile).collect()), key=str)
    assert got == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)) * rng.lognormal(0, 2, (300, 1))
    x[150:] = x[:150] + rng.normal(size=(150, 64)) * np.abs(x[:150]).max(1, keepdims=True) * 0.08
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = V.tile_links(x, x, 0.97)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(unit @ unit.T >= 0.97))))


def test_empty(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324, 1.7e308])
def test_extreme_lengths_link_like_others(spark, size):
    x = np.array([[1.0, 1.0], [1.0, -1.0]]) * size
    i, j = V.tile_links(x, x, 0.98)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 1)]
    rows = [(1, [size, size], 0), (2, [size * 0.99, size], 0), (3, [1.0, 1.0], 0), (4, [-size, size], 0)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
