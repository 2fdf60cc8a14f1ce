import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, target string"


def filled(sizes, weights, share=1.5, cap=2.0):
    total, level = share * sum(sizes), [0.0] * len(sizes)
    clamped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        left = total - sum(cap * sizes[i] for i in clamped)
        level = [cap * sizes[i] if i in clamped else left * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        more = {i for i in free if level[i] > cap * sizes[i]}
        if not more:
            return level
        clamped |= more


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 3, 20, 200]))) if rng.random() > 0.02 else None, rng.choices(sources, [9] + [1] * (len(sources) - 1))[0], "x", "y") for i in range(n)]


def test_water_fill_over_twenty_even_sources(spark):
    sizes = {f"s{i:02d}": 20000 + 613 * (i * 7 % 20) for i in range(20)}
    rows = [(s, n, float([5, 2, 1][i % 3])) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in M.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight double"), 1.5, 2.0).collect()}
    assert got == pytest.approx(dict(zip(sizes, filled(list(sizes.values()), [w for *_, w in rows]))))


@pytest.mark.parametrize("seed,per_bucket", [(1, 1024), (2, 16), (3, 64)])
def test_targets_and_taken(spark, seed, per_bucket):
    rows = rows_of(seed, 1500, ["b", "a", None, "é", "Z"])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r for r in M.mix(df, per_bucket=per_bucket).collect()}
    again = {r.doc_id: r for r in M.mix(df.repartition(3), per_bucket=per_bucket).collect()}
    assert got == again and len(got) == 1500
    order = ["Z", "a", "b", "é", None]
    size = {s: sum(len((t or "").split()) for _, t, x, *_ in rows if x == s) for s in order}
    target = dict(zip(order, filled([size[s] for s in order], [5, 2, 1, 5, 2])))
    for i, t, s, *_ in rows:
        r = got[i]
        assert r.size == len((t or "").split()) and r.source_size == size[s]
        assert r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
    for s in order:
        taken = sum(got[i].taken for i, _, x, *_ in rows if x == s)
        assert abs(taken - target[s]) <= 20 + 0.01 * target[s]


def test_few_sources_and_no_words(spark):
    one = M.mix(spark.createDataFrame([(1, "a b c d", None, "x", "y"), (1, "a b c d", None, "x", "y")], SCHEMA)).collect()
    assert [r.target for r in one] == [12.0, 12.0] and sum(r.taken for r in one) == 12
    none = M.mix(spark.createDataFrame([(1, None, "s", "x", "y"), (2, " ", "s", "x", "y")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed,per_bucket", [(4, 1024), (5, 16), (6, 3)])
def test_taken_is_that_of_a_plain_walk(spark, seed, per_bucket):
    rows = rows_of(seed, 700, ["b", "a", None])
    rows += rows[:5] * 4  # equal rows
    df = spark.createDataFrame(rows, SCHEMA)
    h = F.xxhash64(F.lit(11), "id", "size", "source").bitwiseAND(F.lit((1 << 62) - 1))
    hashed = M.sizes(df, "doc_id", "text", "source").withColumn("h", h).collect()
    targets = {r.doc_id: r.target for r in M.mix(df).collect()}
    expected = []
    for source in {r.source for r in hashed}:
        mine = sorted((r for r in hashed if r.source == source), key=lambda r: (r.h, r.id, r["size"]))
        total, target = sum(r["size"] for r in mine), targets[mine[0].id]
        times, bits = int(target // total), min(20, max(0, math.ceil(math.log2(len(mine) / per_bucket))))
        left, extra, edge = target - times * total, [False] * len(mine), None
        bucket = [(r.h >> 42) // (1 << (20 - bits)) for r in mine]
        for b in sorted(set(bucket)):
            size = sum(r["size"] for r, k in zip(mine, bucket) if k == b)
            if size > left and left > 0:
                edge = b
                break
            if left > 0:
                extra = [x or k == b for x, k in zip(extra, bucket)]
                left -= size
        inside = [i for i, k in enumerate(bucket) if k == edge]
        if edge is None:
            extra = [False] * len(mine)
        for i in inside:
            if mine[i]["size"] <= left:
                extra[i], left = True, left - mine[i]["size"]
        near = [(abs(mine[i]["size"] - left), k, i) for k, i in enumerate(inside) if not extra[i] and mine[i]["size"] < 2 * left]
        if near:
            extra[min(near)[2]] = True
        expected += [(r.id, (times + x) * r["size"]) for r, x in zip(mine, extra)]
    got = [(r.doc_id, r.taken) for r in M.mix(df, per_bucket=per_bucket).collect()]
    assert sorted(got) == sorted(expected)


def test_rows_stay_where_they_are(spark):
    """No exchange of rows by source: the plan is broadcast, and of the rows only those of edge buckets move."""
    df = spark.range(240_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("only").alias("source"))
    plan = M.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
