import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rules as R
from ledgerloom.operators import runs as U


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def broken(df, key, rule_list):
    return sorted((r.entity_id, r.rule_id) for r in R.violations(df, key, rule_list).collect())


def test_acceptance(spark):
    packets = spark.createDataFrame([("p", True, "b", "b"), ("q", False, "b", "b"), ("r", True, "b", "x")], "packet_id string, reviewed boolean, input_binding string, rebuilt_binding string")
    schema = "approval_id int, decision string, export_sha256 string, review_sha256 string, reviewer string, accepted_at string, packet_ids array<string>"
    good = (1, "ACCEPTED", "h", "h", "me", "2024-02-29", ["p"])
    bad = [good, (2, None, "h", "i", "", "2024-2-29", []), (3, *good[1:6], ["p", "p", "q", "r", "z"])]
    approvals = spark.createDataFrame(bad, schema)
    got = rows(U.acceptance_problems(approvals, U.named_packets(approvals), packets))
    assert got == [(2, x) for x in ("no_date", "no_packets", "no_reviewer", "not_accepted", "review_changed")] + [(3, x) for x in ("binding_changed", "not_reviewed", "packet_twice", "unknown_packet")]


def test_protocol_and_decisions(spark):
    df = spark.createDataFrame([(1, "v1", "s", 2, [2023, 2024], [2024]), (2, "v2", "t", 3, [2023, 2023], [2025]), (3, None, "s", 0, [], [])], "id int, schema string, scorer_version string, examples int, filing_years array<int>, standardized_years array<int>")
    assert broken(df, "id", U.protocol_rules("v1", "s")) == [("2", "count"), ("2", "schema"), ("2", "scorer"), ("2", "subset"), ("2", "years"), ("3", "schema"), ("3", "years")]
    d = spark.createDataFrame([(1, "a", "a", ["x"], ["x", "y"], True, "abc", "b"), (2, "a", "b", ["z"], ["x"], True, "abc", "q"), (3, "a", "a", [], [], False, None, None)],
                              "id int, binding string, answer_binding string, quotation_errors array<string>, quotable_paths array<string>, subject_equivalent boolean, cell string, passage string")
    assert broken(d, "id", U.decision_rules()) == [("2", "binding"), ("2", "evidence"), ("2", "quotes")]


def test_events(spark):
    schema = "id int, global_step long, sample_position long, nonpadding_tokens long, supervised_tokens long, full_loop_seconds double, compute_seconds double, compute_timing string"
    df = spark.createDataFrame([(1, 1, 1, 100, 25, 5.0, None, "host_wall"), (2, -1, None, 10, 11, float("nan"), float("inf"), "guess")], schema)
    assert broken(df, "id", U.update_rules()) == [("2", x) for x in ("compute", "count_global_step", "count_sample_position", "seconds", "supervised", "timing")]
    m = spark.createDataFrame([(1, 5, 6, 7, 8, 1, "w"), (2, 5, 6, 4, 6, None, None)], "id int, allocated_bytes long, reserved_bytes long, peak_allocated_bytes long, peak_reserved_bytes long, free_device_bytes long, window_label string")
    assert broken(m, "id", U.memory_rules()) == [("2", "count_free_device_bytes"), ("2", "peak_allocated"), ("2", "window")]
    p = spark.createDataFrame([(1, 3, 1, 5, 2, 1), (2, 6, 1, 5, 7, 1)], "id int, completed int, failed int, total int, previous_completed int, previous_failed int")
    assert broken(p, "id", U.progress_rules()) == [("2", "bounds"), ("2", "monotonic")]


def test_identity_and_limits(spark):
    df = spark.createDataFrame([({"a": "1"}, {"a": "1"}), ({"a": "1", "b": "2"}, {"a": "2"}), ({"a": None}, {"a": "1"}), (None, {})], "x map<string,string>, y map<string,string>")
    state, keys = U.identity_state(F.col("x"), F.col("y"))
    assert [(r.s, r.k) for r in df.select(state.alias("s"), keys.alias("k")).collect()] == [("MATCH", []), ("CHANGED", ["a"]), ("UNVERIFIED", []), ("UNVERIFIED", None)]
    lim = spark.createDataFrame([(2, 0.0, 0.0), (1, 9.0, 99.0), (0, 1.0, 99.0), (1, 1.0, 1.0)], "b int, p double, t double")
    got = lim.select(U.limit_reason(F.col("b"), F.col("p"), F.col("t"), samples=2, phase_limit=9.0, total_limit=99.0)).collect()
    assert [r[0] for r in got] == ["HOST_MEMORY_LIMIT", "PHASE_TIMEOUT", "AGGREGATE_TIMEOUT", None]
    s = spark.createDataFrame([("TERMINATION_MISMATCH", "limit"), ("TERMINATION_MISMATCH", "word"), ("COMPLETE", "limit")], "s string, t string")
    assert [r[0] for r in s.select(U.stopped_status(F.col("s"), F.col("t"))).collect()] == ["LENGTH_STOP", "TERMINATION_MISMATCH", "COMPLETE"]


def test_tables(spark):
    a, b = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(1, None), (3, "y")], "k int, v string")
    assert rows(U.table_diff(a, b)) == [(1, None, "before", 1), (2, "x", "before", 1), (3, "y", "after", 1)]
    ref = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "item string, position int")
    seen = spark.createDataFrame([("s", 0, "a"), ("s", 1, "c"), ("s", 2, "b"), ("s", 3, "z")], "k string, i int, item string")
    assert sorted(r.item for r in U.out_of_order(seen, ["k"], ["i"], ref, "item", "position").collect()) == ["b", "z"]
    saved, rebuilt = spark.createDataFrame([("p", "1", "2"), ("q", "1", None)], "id string, a string, b string"), spark.createDataFrame([("p", "1", "3"), ("q", "1", None)], "id string, a string, b string")
    assert rows(U.rebuilt_differences(saved, rebuilt, "id", ["a", "b"])) == [("p", "b")]


def test_orders_are_the_generator_s():
    rng = random.Random(7)
    want = []
    for e in range(2):
        x = list(range(5))
        rng.shuffle(x)
        want += [(e, i, p) for i, p in enumerate(x)]
    assert list(U.epoch_orders(7, 5, 2)) == want


def test_recovery(spark):
    j = spark.createDataFrame([("a", 1, "READY"), ("a", 2, "CLEAN_STOP"), ("b", 1, "CLEAN_STOP"), ("b", 3, "UPDATING")], "run string, position int, status string")
    assert rows(U.journal_states(j)) == [("a", "CLEAN_STOP", True), ("b", "UPDATING", False)]
    req = spark.createDataFrame([(s, i) for s in "abc" for i in range(3)], "session string, index int")
    cap = spark.createDataFrame([("a", 0, "COMPLETE"), ("b", 0, "COMPLETE")], "session string, index int, status string")
    ends = spark.createDataFrame([("a", 1, "CRASH"), ("b", 1, "TIME_LIMIT"), ("c", 0, "USER_STOP")], "session string, active_index int, reason string")
    got = {(r.session, r["index"]): r.status for r in U.attributed(req, cap, ends).collect()}
    assert [got[s, i] for s in "abc" for i in range(3)] == ["COMPLETE", "FAILED", "PENDING", "COMPLETE", "TIMEOUT", "PENDING", "PENDING", "PENDING", "PENDING"]
    led = spark.createDataFrame([("x", "STARTED", 60.0), ("x", "COMPLETE", 5.0), ("y", "STARTED", 60.0), ("z", "FAILED", 1.0), ("z", "FAILED", 1.0)], "execution_id string, status string, elapsed_seconds double")
    assert rows(U.settled_charges(led)) == [("x", 5.0, False, False), ("y", 60.0, True, False), ("z", 1.0, False, True)]


def test_review_history(spark):
    rev = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 3, None), ("f", 4, "b"), ("g", 1, "z")], "field string, at int, v string")
    assert rows(U.change_log(rev, ["field"], "at", "v")) == [("f", 3, "a", None), ("f", 4, None, "b")]
    f = spark.createDataFrame([("a", ""), ("b", "mine"), ("c", None)], "field string, value string")
    d = spark.createDataFrame([("a", "d1"), ("b", "d2")], "field string, value string")
    assert rows(U.revealed(f, d, ["field"])) == [("a", "d1", ""), ("b", "mine", "mine"), ("c", None, None)]
    m = spark.createDataFrame([("p", "h", bytearray(b"x")), ("p", "h", bytearray(b"x")), ("q", "i", None)], "source_path string, source_sha256 string, content binary")
    s = spark.createDataFrame([(1, "p", "h"), (2, "p", "i")], "id int, source_path string, source_sha256 string")
    assert {r.id: r.content for r in U.retained(s, m).collect()} == {1: bytearray(b"x"), 2: None}


def test_breaks_of_a_chain(spark):
    a, b, c = (spark.createDataFrame(x, "needs string, makes string") for x in ([(None, "1"), (None, "2"), (None, "2"), (None, None)], [("1", "x"), ("1", "y"), ("3", "z"), (None, "w")], [("x", None), ("v", None)]))
    got = sorted(map(str, (tuple(r) for r in U.chain_problems([("a", a, "needs", "makes"), ("b", b, "needs", "makes"), ("c", c, "needs", "makes")]).collect())))
    assert got == sorted(map(str, [("b", "3", "unbound"), ("b", None, "unbound"), ("a", "2", "unused"), ("c", "v", "unbound"), ("b", "w", "unused"), ("b", "y", "unused"), ("b", "z", "unused")]))


@pytest.mark.parametrize("status", U.TERMINAL)
def test_terminal_and_interrupted_are_apart(status):
    assert status not in U.INTERRUPTED
