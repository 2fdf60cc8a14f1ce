import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import runs as U
from ledgerloom.sources import config as C

KNOWN = {"HOME": "/h", "A": "x"}


def test_expansion_and_limits(tmp_path):
    assert C.expanded({"a": ["~/$A/${A}y", 3, None], "b": "a~"}, KNOWN) == {"a": ["/h/x/xy", 3, None], "b": "a~"}
    with pytest.raises(KeyError):
        C.expanded("$MISSING", KNOWN)
    for bad in ({"n": 0}, {"n": True}, {"n": float("inf")}, {"n": "1"}, {}):
        with pytest.raises(ValueError):
            C.limits(bad, ("n",))
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"limits": {"n": 2.5}, "at": "$A"}))
    assert C.load(str(p), ("n",), KNOWN)["at"] == "x"
    p.write_text('{"a":1,"a":2}')
    with pytest.raises(ValueError):
        C.load(str(p))


def test_summary(spark):
    df = spark.createDataFrame([("COMPLETE", 4, 3, 2), ("PENDING_REVIEW", 4, None, None), ("INCOMPLETE", 0, None, None)], "status string, targets int, format_valid int, correct int")
    assert [(r.ratio, r.exit_code) for r in U.summary(df).collect()] == [(0.5, 0), (None, 2), (None, 1)]
    s = spark.createDataFrame([("RUNNING", None, None), ("EXITED", 0, "TRAINED"), ("EXITED", 1, "TRAINED"), ("EXITED", 0, None)], "w string, c int, s string")
    assert [r[0] for r in s.select(U.run_status(F.col("w"), F.col("c"), F.col("s"))).collect()] == ["RUNNING", "TRAINED", "EXITED", "EXITED"]
