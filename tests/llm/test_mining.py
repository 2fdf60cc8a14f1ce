import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mining

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10):
    """Every product of every pair, as integers."""
    clean = [(i, tuple(int(np.floor(256 * x)) for x in e), label) for i, e, label in rows if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for k, (a, x, label) in enumerate(clean):
        if not anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b, other) for j, (b, y, other) in enumerate(clean) if j != k and len(x) == len(y)]
        for ps, pid, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(a, pid, r + 1, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def check(spark, rows, every=3, **named):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(n) for n in ("id", "key", "v", "dims", "tile", "lane", "anchor", "score", "scores")]).repartition(3)
    expected = brute(rows, lambda i: i % every == 0)
    assert got(mining.mine(df, F.col("vec_id") % every == 0, **named)) == expected
    return expected


def clustered(n, dims, seed, spread=0.4):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, dims))
    return [(k, (middle[k % 6] + spread * r.normal(size=dims)).tolist(), int(r.integers(0, 4))) for k in range(n)]


def test_against_all_products(spark):
    assert len(check(spark, clustered(400, 16, 1))) > 1000


@pytest.mark.parametrize("dims", [1, 2, 3, 7])
def test_few_dimensions(spark, dims):
    check(spark, clustered(90, dims, dims), every=10)


def test_ties_copies_and_repeated_rows(spark):
    rows = [(k, [0.5, -0.25, 0.125], k % 2) for k in range(60)] + [(k, [0.3, -0.1, 0.1], 1) for k in range(60, 90)]
    check(spark, rows + rows[:7] + [(0, [0.4, 0.4, 0.4], 0)], every=20)


def test_faulty_rows_take_no_part(spark):
    rows = clustered(60, 4, 9)
    rows += [(None, [1.0] * 4, 1), (90, None, 1), (93, [1.0, None, 1.0, 1.0], 1), (96, [float("nan")] * 4, 1), (99, [float("inf"), 0.0, 0.0, 0.0], 1), (102, [1.0] * 4, None)]
    rows += [(105, [0.0] * 4, 1), (108, [1.0] * 5, 1), (111, [1.1] * 5, 1), (112, [0.7] * 5, 2), (114, [], 1), (115, [], 1), (116, [], 2)]
    check(spark, rows)


def test_too_long_vectors_take_no_part(spark):
    rows = clustered(40, 3, 2)
    expected = brute(rows, lambda i: i % 3 == 0)
    wide = spark.createDataFrame(rows + [(300, [1e300, 1.0, 1.0], 1), (303, [3e6, 0.0, 0.0], 1), (306, [1.7e308] * 3, 1)], SCHEMA)
    assert got(mining.mine(wide.coalesce(1), F.col("vec_id") % 3 == 0)) == expected
    large = clustered(40, 3, 2)
    check(spark, [(k, [1e4 * x for x in e], label) for k, e, label in large])


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame(clustered(20, 3, 2), SCHEMA)
    assert got(mining.mine(df.where("false"), F.lit(True))) == [] and got(mining.mine(df, F.lit(False))) == [] and got(mining.mine(df, F.lit(None).cast("boolean"))) == []


def test_many_tiles_lanes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mining, "TILE_BYTES", 1024)
    monkeypatch.setattr(mining, "LANES", 3)
    monkeypatch.setattr(mining, "STEP", 16)
    check(spark, clustered(300, 8, 4))


def test_most_pairs_are_discarded_before_integers():
    r = np.random.default_rng(7)
    middle = r.normal(size=(10, 64)) @ np.diag(0.9 ** np.arange(64))
    x = np.floor(256 * (middle[r.integers(0, 10, 4000)] + 0.05 * r.normal(size=(4000, 64)))).astype(np.int32)
    q = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    labels = r.integers(0, 10, 4000)
    unit = mining.Unit(q, x[:200], np.arange(200), labels[:200], 5)
    unit.rows(np.arange(4000), np.arange(4000), labels, x)
    assert unit.verified < 0.1 * 200 * 400


def test_bounds_hold_for_every_pair():
    r = np.random.default_rng(8)
    x, y = (np.floor(256 * r.normal(size=(200, 24))).astype(np.int32) for _ in range(2))
    q = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    a, b, exact = mining.Side(x, q), mining.Side(y, q), x.astype(np.int64) @ y.astype(np.int64).T
    part = 0
    for step in (0, 1):
        part = part + a.lead[step] @ b.lead[step].T
        width = np.outer(a.rest[step], b.rest[step]) + mining.slack(q) * np.outer(a.norm, b.norm)
        assert (exact <= part + width).all() and (exact >= part - width).all()
