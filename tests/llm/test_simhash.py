import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash as S
from ledgerloom.llm.common import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    ids = {}
    for (k, _), r in zip(rows, root):
        if k is not None:
            ids[r] = min(k, ids.get(r, k))
    return sorted(((k, f"{p:016x}", ids.get(r)) for (k, _), p, r in zip(rows, prints, root)), key=str)


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = S.covering_masks(4), random.Random(1)
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 30
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_bucket_links_span_components(n):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 1 << 9, n).astype(np.uint64)
    i, j = S.bucket_links(prints, 1)
    root = list(range(n))
    for _ in range(n):
        for a, b in zip(i, j):
            root[a] = root[b] = min(root[a], root[b])
    want = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if int(prints[a] ^ prints[b]).bit_count() <= 1:
                    want[a] = want[b] = min(want[a], want[b])
    assert root == want


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 60, 400]))]
        for k in range(5):
            edit = list(base)
            if k and len(edit) > 50:
                edit[rng.randrange(len(edit))] = f"x{k}"
            rows.append((i * 10 + k, " ".join(edit)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One TWO"), (904, "one two"), (None, "one two"), (None, "nothing like it at all here"), (904, "one two")]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_large_buckets_are_dealt_out(spark):
    rng = random.Random(6)
    prints = sorted({rng.getrandbits(7) | rng.getrandbits(5) << 40 for _ in range(400)})
    rows = [(1, 0, p, i) for i, p in enumerate(prints)] + [(2, 5, p, 1000 + i) for i, p in enumerate(prints[:9])]
    df = spark.createDataFrame(rows, "t int, key long, fp long, rep long")
    whole = df.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(S._link_buckets(1, 10**6), S._LINKS).select("a", "b")
    handed = df.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(S._link_buckets(1, 20), S._LINKS).cache()
    large = handed.where("t is not null").select("t", "key", "fp", F.col("b").alias("rep"))
    assert large.count() == len(prints)
    both = handed.where("t is null").select("a", "b").unionByName(S._dealt(large, 1, 20))
    told = lambda links: sorted(tuple(r) for r in connected_components(links).collect())
    assert told(both) == told(whole) and len({c for _, c in told(whole)}) > 3


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
