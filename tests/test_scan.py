"""Running values in parts against windows, with one key that has 90 % of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import ordered, scan


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    key = F.when(i % 10 > 0, "hot").when(i % 30 == 0, None).otherwise(F.concat(F.lit("k"), i % 40))
    df = spark.range(3000).select(key.alias("k"), (i * 7919 % 3000).alias("at"), F.when(i % 11 == 0, None).otherwise(i * 31 % 97).alias("v"), (i % 13).cast("double").alias("d"), (i * 17 % 50).alias("start"))
    return df.withColumn("end", F.col("start") + F.col("at") % 4).repartition(5).cache()


def same(a, b):
    assert a.columns == b.columns
    told = lambda df: sorted(map(str, df.collect()))
    assert told(a) == told(b)


def folds():
    return {
        "s": scan.Fold("sum", F.col("v")), "sb": scan.Fold("sum", F.col("v"), before=True), "lo": scan.Fold("min", F.col("v")), "hi": scan.Fold("max", F.col("v"), before=True), "n": scan.Fold("count"),
        "f": scan.Fold("first", F.col("v")), "p": scan.Fold("lag", F.col("v")), "q": scan.Fold("lead", F.col("v")),
    }


@pytest.mark.parametrize("down", [False, True])
def test_parts_are_windows(rows, down):
    order = [F.col("at").desc()] if down else ["at"]
    same(scan.running(rows, ["k"], order, folds(), hot=100), scan.running(rows, ["k"], order, folds()))


def test_all_ordered_operators(rows, monkeypatch):
    at = [F.col("at")]
    calls = [
        lambda d: ordered.positions(d, ["k"], ["at"]), lambda d: ordered.charges(d, ["k"], at, F.col("v"), 500), lambda d: ordered.extremes(d, ["k"], at, "v"), lambda d: ordered.gaps(d, ["k"], "start", "end", "at"),
        lambda d: ordered.overlaps(d, ["k"], "start", "end", [F.col("start"), F.col("at")]), lambda d: ordered.not_increasing(d, ["k"], at, "v"), lambda d: ordered.adjacent(d, ["k"], at, ["v", "d"]), lambda d: ordered.periods(d, ["k"], at),
        lambda d: ordered.remaining(d, ["k"], at, "d", "at", 2000), lambda d: ordered.runs_below(d, ["k"], at, F.col("v") < 60), lambda d: ordered.bucket_changes(d, ["k"], at, "v"), lambda d: ordered.shown_counters(d, ["k"], at, "v"),
        lambda d: ordered.rolling(d, ["k"], at, {"s": F.col("v")}),
    ]
    windows = [c(rows) for c in calls]
    monkeypatch.setattr(scan, "HOT", 100)
    for c, w in zip(calls, windows):
        same(c(rows), w)


def test_runs_below_against_islands(rows):
    w = Window.partitionBy("k").orderBy("at")
    low = F.coalesce(F.col("v") < 60, F.lit(False))
    islands = rows.withColumn("i", F.sum((~low).cast("int")).over(w)).withColumn("below_count", F.sum(low.cast("long")).over(Window.partitionBy("k", "i").orderBy("at")))
    same(ordered.runs_below(rows, ["k"], ["at"], F.col("v") < 60).select("k", "at", "below_count"), islands.select("k", "at", "below_count"))


def test_no_part_has_over_twice_its_share(spark, rows, monkeypatch):
    seen = []
    cut = scan.cut
    monkeypatch.setattr(scan, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    scan.running(rows, ["k"], ["at"], {"n": scan.Fold("count")}, hot=300)
    held = next(d for d in seen if "_scan_rn" in d.columns)
    sizes = [r["count"] for r in held.groupBy("_scan_part").count().collect()]
    assert sum(sizes) == 2700 and len(sizes) >= 15 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_no_rows(rows):
    assert scan.running(rows.where("false"), ["k"], ["at"], folds(), hot=0).count() == 0
