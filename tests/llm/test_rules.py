import re

import duckdb
import pandas as pd

from ledgerloom.llm import rules as R

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, fail_bits string"
TEXTS = [
    None, "", " \n\t", "a b c", "a b c a b c", "a a a a", "x y", "alpha beta gamma " * 30,
    "one two three\none two three\n\n \none two three\n", "# $ % & | < > * ok word",
    "- item\n* item\n• item ...\nlast…", "é\U0001f600 b\x0bc\x0cd", "w " * 3000,
    " ".join(f"w{i}" for i in range(400)), "A a A a a A A a A", " ".join(f"w{i}" for i in range(60)) + " w3 w4 w5",
]


def plain(text):
    t = text or ""
    words = [w for w in WS.split(t) if w]
    lines = [x for x in t.split("\n") if WS.sub("", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), len("".join(words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.measure(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_bits_and_ablations(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA)
    led = R.ledger(df)
    bits = [r.fail_bits for r in led.collect()]
    for policy in R.POLICIES:
        want = {}
        for name in policy.rules:
            bit = 1 << R.RULES.index(name)
            masks = [b & policy.mask for b in bits]
            want[name] = (sum(m & bit > 0 for m in masks), sum(m == bit for m in masks), sum(m & ~bit == 0 for m in masks))
        got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in R.ablations(led, policy).collect()}
        assert got == want


def test_sql_agrees(spark, tmp_path):
    data = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})
    (tmp_path / "sf").mkdir()
    data.to_parquet(tmp_path / "sf" / "documents.parquet")
    got = R.op6_rule_ledger(spark, str(tmp_path / "sf")).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/sf/documents.parquet'")
    want = con.execute(R.OP6_SQL).df().sort_values("doc_id")
    assert got.values.tolist() == want[got.columns.tolist()].values.tolist()


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = R.ledger(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert R.ledger(spark.createDataFrame([], SCHEMA)).collect() == []
