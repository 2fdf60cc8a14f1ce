"""Steps whose cost grew faster than their rows: what their plans and rows may hold."""

import json

from pyspark.sql import functions as F

from ledgerloom.functions import markup as M
from ledgerloom.operators import labels as L
from ledgerloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_review_labels_are_spelled_once(spark):
    """One pass tells labels and faults, and a label is parsed once, not by each of its fourteen fields."""
    told = plan(QUERIES["review_labels"](spark, SF))
    assert told.count("Relation [") == 1 and told.count("Generate explode(transform") >= 1
    label = spark.createDataFrame([(1, "{}")], "i int, t string")
    above, below = plan(L.review_fields(label, "i", "t")).split("Generate ", 1)
    assert "parseJson" not in above and "parseJson" in below


def test_odd_review_texts(spark):
    empty = {"value": None, "raw_text": None, "availability": "ABSENT_IN_CONTEXT", "origin": None}
    df = spark.createDataFrame([(i, json.dumps({"fields": dict.fromkeys(L.CONTRACT, empty)})) for i in range(7)], "i int, t string")
    at = lambda i: (F.col("i") == i) & (F.col("field") == "ticker")
    f = L.review_fields(df, "i", "t").withColumns({
        "availability": F.when(at(0), None).when(at(1), 'AB"SENT').otherwise(F.col("availability")), "origin": F.when(at(2), 'x"y').when(at(3), "DERIVED").otherwise(F.col("origin")),
        "value": F.when(at(4), " null ").when(at(5), None).otherwise(F.col("value")), "field": F.when(at(6), None).otherwise(F.col("field")),
    })
    found = {r.i: (r.label is not None, [tuple(x) for x in r.faults]) for r in L.review_results(f, "i").collect()}
    unknown, filled = [("ticker", "unknown_availability")], [("ticker", "unresolved_but_filled")]
    assert found == {0: (False, unknown), 1: (False, unknown), 2: (False, filled), 3: (False, filled), 4: (True, []), 5: (False, [("ticker", "json")]), 6: (False, [("label", "json")])}
    good, wrong = L.from_review(f, "i")
    assert [r.i for r in good.collect()] == [4] and sorted(r.i for r in wrong.collect()) == [0, 1, 2, 3, 5, 6]


def test_blocks_of_odd_ranges(spark, monkeypatch):
    """Ranges of contents are found as in the whole content, whatever is sent of it."""
    monkeypatch.setattr(M, "HANDED", 8)
    contents = [("a\n\u00e9b\n<tr>\n<td>x\n</td><td colspan=2>y</td></tr>\nz", "utf-8"), ("\u00e9\nb\n<td>\u00fc</td>", "latin-1"), ("a\nb", "utf-16"), ("", "utf-8")]
    ranges = [(0, 4), (2, 5), (2, 4), (3, 9), (0, 500), (4, 4), (5, 3), (-3, 6), (-4, -1), (4, 8), (900, 901), (2, None), (None, 3)]
    rows = [(t.encode(e), a, b, k, e) for t, e in contents for k in ("text", "row", "cell", "other") for a, b in [*ranges, (t.encode(e).find(b"<"), t.encode(e).rfind(b">") + 1)]]
    rows.append((None, 0, 1, "text", "utf-8"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c binary, a long, b long, k string, e string")
    got = {r.i: r.x.asDict(True) for r in df.select("i", M.blocks(*map(F.col, "cabke")).alias("x")).collect()}
    good = 0
    for i, (c, a, b, k, e) in enumerate(rows):
        try:
            want = M.block(bytes(c), int(a), int(b), k, e)
        except (ValueError, LookupError, TypeError):
            assert got[i]["error"] is not None and got[i]["cells"] is None, rows[i]
            continue
        good += 1
        cells = [{n: x.get(n) for n in ("text", "colspan", "rowspan", "start_byte", "end_byte")} for x in want.pop("cells")]
        assert got[i] == {"error": None, **want, "cells": cells}, rows[i]
    assert good > 20


def test_packets_send_ranges_not_contents(spark):
    """What Python gets of a document is each range's bytes; the content itself is in no argument."""
    told = plan(QUERIES["packet_cells"](spark, SF))
    call = next(x for x in told.splitlines() if "ArrowEvalPython" in x)
    assert "run(content" not in call, call
