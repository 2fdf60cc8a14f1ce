"""Chains, resume points and ledgers of fetches against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import fetches, histories, scan

CHAIN = "run string, hash string, parent string, sound boolean, hash2 string"


def depths(rows):
    """Depth of each row by walking to the beginning; None where the walk is cut."""
    by = {}
    for run, own, *rest in rows:
        by.setdefault((run, own), []).append(rest)
    out = {}
    for run, own, *_ in rows:
        at, n, seen = own, 0, set()
        while at is not None:
            found = by.get((run, at), [])
            if len(found) != 1 or at in seen or not found[0][1] or own is None:
                n = None
                break
            seen.add(at)
            n, at = n + 1, found[0][0]
        out[run, own] = n if own is not None else None
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], CHAIN).repartition(3)
    chains = histories.chained(df).cache()
    want = depths(rows)
    assert sorted(((r.run, r.hash, r.depth) for r in chains.collect()), key=str) == sorted(((run, own, want[run, own]) for run, own, *_ in rows), key=str)
    points = {r.run: (r.hash, r.depth, r.rows, r.cut_off) for r in histories.resume_points(chains).collect()}
    for run in {r[0] for r in rows}:
        mine = [(want[run, own], own) for x, own, *_ in rows if x == run]
        best = max((d for d, _ in mine if d is not None), default=0)
        ends = [own for d, own in mine if d == best and best]
        assert points[run] == (min(ends) if ends else None, best, len(mine), sum(d is None for d, _ in mine))


def test_chains_with_forks_rings_and_broken_links(spark):
    long = [("long", f"n{i:03d}", f"n{i - 1:03d}" if i else None, i != 77) for i in range(100)]
    rows = [*long, ("a", "1", None, True), ("a", "2", "1", True), ("a", "3", "1", True), ("a", "4", "3", True), ("a", "5", "gone", True), ("b", "1", "2", True), ("b", "2", "1", True), ("b", "3", "3", True), ("c", "1", None, False), ("c", "2", "1", True)]
    rows += [("d", "1", None, True), ("d", "1", None, True), ("d", "2", "1", True), (None, "1", None, True), (None, "2", "1", True), ("", "1", None, None), ("e", None, None, True), ("e", "x", None, True), ("f", "2", "1", True)]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_chains(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), f"h{i}", rng.choice([None, "gone", *[f"h{k}" for k in range(max(0, i - 4), i + 2)]]), rng.random() > 0.05) for i in range(120)]
    check(spark, rows)


def test_no_chains(spark):
    df = spark.createDataFrame([], CHAIN)
    assert histories.resume_points(histories.chained(df)).collect() == []


LEDGER = "ledger string, position long, at long, kind string, status string, http_status int, retry_after string, bytes long, url string, output string, sha256 string"


def problems(rows, pause, window, most, max_bytes, max_filings):
    out = []
    for ledger in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == ledger), key=lambda r: r[1])
        last, closed, held, filings, done = None, False, 0, 0, set()
        for _, n, at, kind, status, http, retry, size, url, output, sha in mine:
            blocks = status == "blocked" or http in (403, 429) or bool(retry)
            told = {
                "unknown_status": status not in fetches.STATUSES, "too_soon": last is not None and at - last < pause, "too_many": sum(at - window <= r[2] <= at for r in mine) > most, "after_block": closed,
                "over_bytes": held >= max_bytes, "over_filings": kind == "filing" and filings >= max_filings, "block_not_told": blocks and status is not None and status != "blocked",
                "not_complete": status == "complete" and not (http == 200 and sha is not None and len(sha) == 64), "fetched_again": status == "complete" and (url, output) in done,
            }
            out += [(ledger, n, rule) for rule, wrong in told.items() if wrong]
            last, closed, held = at, closed or blocks, held + (size or 0)
            filings += kind == "filing" and http == 200 and (size or 0) > 0
            done |= {(url, output)} if status == "complete" else set()
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 20, 20])
def test_fetches_against_a_plain_walk(spark, monkeypatch, hot):
    monkeypatch.setattr(scan, "HOT", hot)
    monkeypatch.setattr(fetches, "STRETCH", 50)
    rng, rows = random.Random(hot), []
    for ledger in "abc":
        at = 0
        for n in range(80 if ledger == "a" else 15):
            at += rng.choice([0, 1, 3, 7, 20, 60])
            rows.append((ledger, n, at, rng.choice(["filing", "index"]), rng.choice([*fetches.STATUSES, "complete", "odd", None]), rng.choice([200] * 20 + [404, 429, None]), rng.choice([None] * 20 + ["", "9"]), rng.choice([None, 0, 5, 50]), f"u{rng.randrange(30)}", "o", rng.choice(["a" * 64, "z", None])))
    limits = {"pause": 4, "window": 25, "most": 3, "max_bytes": 300, "max_filings": 6}
    found = fetches.fetch_problems(spark.createDataFrame(rows, LEDGER).repartition(3), **limits)
    assert sorted(map(tuple, found.collect())) == problems(rows, **limits)


def test_history_rows(spark):
    rows = [("r", 1, 1, 5, 0.5, 1.0), ("r", 2, 3, 5, 0.5, 1.0), ("r", 3, 3, 0, 0.5, 1.0), ("r", 4, 4, 5, float("inf"), 1.0), ("r", 5, 5, 5, 0.5, -1.0), ("r", 6, None, None, None, None), ("s", 9, 1, 5, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "run string, position long, step long, response_tokens long, loss double, update_seconds double")
    got = sorted(map(tuple, histories.history_problems(df).collect()))
    assert got == [("r", 2, "step"), ("r", 3, "tokens"), ("r", 4, "measurement"), ("r", 5, "measurement"), ("r", 6, "measurement"), ("r", 6, "step"), ("r", 6, "tokens")]
    assert histories.history_problems(df.where(F.lit(False))).collect() == []
