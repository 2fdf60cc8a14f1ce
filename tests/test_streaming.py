import json
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.streaming import attempts as A
from ledgerloom.streaming import events as E


def line(**changes):
    return json.dumps({"schema_version": "training-event-v1", "kind": "update", "attempt_id": "a", "attempt_elapsed_seconds": 1.5} | changes)


LINES = [(line(), True), (line(kind="other"), False), (line(attempt_elapsed_seconds=True), False), (line(attempt_elapsed_seconds=-1), False), ("plain", False), ("[1]", False), (line(attempt_elapsed_seconds=float("nan")), False),
         (line(schema_version="v0"), False), ("", False), (line(attempt_elapsed_seconds="1"), False), (line(attempt_elapsed_seconds=0), True), (line(attempt_elapsed_seconds=10**30), True), (line(attempt_elapsed_seconds=None), False),
         (line() + "x", False), (line(kind=3), False), (line(attempt_id=None), True), (None, False), ('{"schema_version": "training-event-v1", "kind": "phase", "attempt_elapsed_seconds": 1e400}', False)]


def test_events_never_fail(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "i int, t string").select("i", E.events("t").alias("e")).select("i", "e.*").orderBy("i").collect()
    assert [r.kind is not None for r in got] == [ok for _, ok in LINES] and all((r.event is None) == (r.kind is None) == (r.seconds is None) for r in got)
    assert json.loads(got[0].event) == json.loads(line()) and (got[0].kind, got[0].attempt_id, got[0].seconds) == ("update", "a", 1.5)


def test_attempts_over_restarts_and_silence(spark, tmp_path):
    def put(rows):
        told = [(k, datetime(2024, 1, 1) + timedelta(minutes=m), n, kind, *x) for k, m, n, kind, *x in rows]
        spark.createDataFrame(told, A.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(A.EVENT).parquet(f"{tmp_path}/in")
        with A.large_state(spark):
            E.run_to_end(A.attempt_state(stream, late="0 seconds"), E.append_to(f"{tmp_path}/out"), f"{tmp_path}/check")
        found = E.committed(spark, f"{tmp_path}/out")
        return {r.attempt: r for r in A.newest(found).collect()}, sorted(r.attempt for r in found.where("silent").collect())

    up = lambda k, m, n, step, position, loss: (k, m, n, "update", step, position, 100, loss, 2, None, None, None)
    put([up(1, 0, 2, 5, 20, 7), up(1, 0, 1, 4, 16, 9), up(1, 1, 3, 3, 12, 1), up(1, 1, 4, 6, 19, 1), up(1, 1, 5, 101, 404, 1), (1, 1, 6, "memory", None, None, None, None, None, 44, None, None), (2, 0, 1, "phase", None, None, None, None, None, None, "saving", None)])
    states, silent = run()
    one = states[1]
    assert (one.seen, one.updates, one.ignored, one.step, one.position, one.loss, one.memory, one.loss_12, one.examples_12) == (6, 2, 3, 5, 20, 7, 44, 32, 4) and states[2].phase == "saving" and silent == []
    put([up(1, 30, 7 + k, 6 + k, 24 + 4 * k, k) for k in range(14)] + [(1, 31, 30, "attempt", None, None, None, None, None, None, None, "CLEAN_STOP"), (1, 31, 31, "guess", *[None] * 8)])
    states, silent = run()
    one = states[1]
    assert (one.seen, one.updates, one.ignored, one.step, one.status, one.loss_12, one.examples_12) == (22, 16, 4, 19, "CLEAN_STOP", 2 * sum(range(2, 14)), 24)
    put([(3, 200, 1, "phase", None, None, None, None, None, None, "training", None)])
    _, silent = run()
    put([(3, 201, 2, "phase", None, None, None, None, None, None, "training", None)])
    states, silent = run()
    assert set(silent) == {1, 2} and states[1].seen == 22 and len(silent) == len(set(silent))


def test_attempts_in_another_zone_with_large_numbers(spark, tmp_path):
    """Timers follow instants, not the session's clock; numbers beside nulls keep all digits; unknown keys, times and counters are told."""
    large, none = (1 << 53) + 1, [None] * 8
    up = lambda k, at, n, step, loss, examples=1: (k, at, n, "update", step, 4 * large, large, loss, examples, None, None, None)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [up(1, at(0), 1, 5, large), up(1, at(0), 2, 6, None), (1, at(0), 3, "memory", None, None, None, None, None, large, None, None), (1, at(0), 4, "phase", *none),
            up(2, at(0), 1, 5, 3, None), (2, at(0), 2, "memory", None, None, None, None, None, 8, None, None), (2, at(0), 3, "memory", *none), (2, at(0), None, "attempt", *none[:-1], "LAST"), (2, at(0), large, "attempt", *none[:-1], "FIRST"),
            (None, at(0), 1, None, *none), (None, None, 2, "update", *none), (4, None, 1, "phase", *none[:-2], "saving", None), (5, at(50), 1, "phase", *none[:-2], "saving", None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.createDataFrame(rows, A.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with A.large_state(spark):
            E.run_to_end(A.attempt_state(spark.readStream.schema(A.EVENT).parquet(f"{tmp_path}/in"), late="0 seconds"), E.append_to(f"{tmp_path}/out"), f"{tmp_path}/check")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    found = E.committed(spark, f"{tmp_path}/out")
    told = {r.attempt: tuple(r)[1:-2] for r in A.newest(found).collect()}
    assert told == {1: (4, 2, 0, 6, 4 * large, None, large, None, None, large, 1), 2: (5, 1, 0, 5, 4 * large, 3, None, None, "LAST", 0, 0), None: (2, 0, 2, *[None] * 6, 0, 0),
                    4: (1, 0, 0, None, None, None, None, "saving", None, 0, 0), 5: (1, 0, 0, None, None, None, None, "saving", None, 0, 0)}
    assert {r.attempt for r in found.where("silent").collect()} == {1, 2, 4, None}


def test_attempts_hand_their_state_on_with_their_rows(spark, tmp_path):
    """No attempt asks the store by itself, and Python gets four columns: each column of each attempt is a cost of its own."""
    spark.createDataFrame([], A.EVENT).write.parquet(f"{tmp_path}/in")
    told = A.attempt_state(spark.readStream.schema(A.EVENT).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    sent = re.search(r"FlatMapGroupsInPandasWithState \w+\(([^)]*)\)", told)
    assert sent and [c.split("#")[0].strip() for c in sent[1].split(",")] == ["attempt", "at", "numbers", "text"]


def test_two_sinks_and_a_repeated_batch(spark, tmp_path):
    commit = E.durable_and_shown(f"{tmp_path}/kept", f"{tmp_path}/shown", ["n"], 3)
    for batch, size in ((0, 5), (0, 5), (1, 2), (2, 0)):
        commit(spark.range(size).select((F.col("id") + 10 * batch).alias("n"), F.lit("x").alias("t")), batch)
    assert sorted(r.n for r in E.committed(spark, f"{tmp_path}/kept").collect()) == [0, 1, 2, 3, 4, 10, 11]
    assert sorted((r.shown, r.dropped, [x.n for x in r.lines]) for r in E.committed(spark, f"{tmp_path}/shown").collect()) == [(0, 0, []), (2, 0, [10, 11]), (3, 2, [0, 1, 2])]


def test_state_over_files_and_restart(spark, tmp_path):
    schema = "key long, counter long, value string"

    def put(n, data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        E.run_to_end(E.keyed_state(stream), E.append_to(f"{tmp_path}/out"), f"{tmp_path}/check")
        found = E.committed(spark, f"{tmp_path}/out").groupBy("key").agg(F.max_by(F.struct("counter", "value", "seen"), "seen").alias("x"))
        return {r.key: tuple(r.x) for r in found.collect()}

    put(0, [(1, 5, "a"), (1, 4, "b"), (2, 1, "c")])
    assert run() == {1: (5, "a", 2), 2: (1, "c", 1)}
    put(1, [(1, 5, "z"), (2, 9, "d")])
    assert run() == {1: (5, "a", 3), 2: (9, "d", 2)}


def test_first_commit_stays(spark):
    rows = spark.createDataFrame([("k", "a", 0), ("k", "a", 1), ("j", "x", 1), ("j", "y", 2)], "key string, value string, batch int")
    assert sorted(tuple(r) for r in E.settled(rows, "key", "value").collect()) == [("j", "x", 1), ("k", "a", 0)]
