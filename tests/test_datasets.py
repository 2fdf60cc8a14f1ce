import hashlib
import json

from pyspark.sql import functions as F

from ledgerloom.functions.canonical import encode
from ledgerloom.operators import datasets as D
from ledgerloom.operators import packets as P
from tests.test_labels_and_scoring import absent, mixed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def line(user="input", system="prompt", label=None, roles=("system", "user", "assistant")):
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in zip(roles, (system, user, json.dumps(label or absent())))]}, ensure_ascii=False)


def test_dataset_reader(spark):
    bad = absent()
    bad["fields"]["ticker"]["availability"] = "MAYBE"
    told = [line(), line(user="other"), line(label=bad), line(system="x"), '{"a":1,"a":2}', line(roles=("user", "user", "assistant")), line(label=mixed())]
    lines = spark.createDataFrame([("training", i, t) for i, t in enumerate(told)], "split string, position int, value string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ex = [(f"p{i}", "training", i, sha(t), "training") for i, t in enumerate(told[:6])] + [("p9", "training", 9, "x", "test"), ("p0b", "training", 0, sha(told[0]), "development")]
    examples = spark.createDataFrame(ex, "packet_id string, split string, position int, row_sha256 string, selection_split string")
    inputs = spark.createDataFrame([(f"p{i}", "input") for i in (*range(6), "0b")], "packet_id string, model_input string")
    got = rows(D.dataset_problems(lines, examples, "prompt", inputs))
    assert got == sorted([("p0", "position_twice"), ("p0b", "position_twice"), ("p0b", "split_differs"), ("p1", "input_differs"), ("p2", "label"), ("p3", "prompt"), ("p4", "not_json"), ("p5", "roles"),
                          ("p9", "no_row"), ("p9", "split_differs"), ("training:6", "no_example")], key=str)
    changed = examples.withColumn("row_sha256", F.lit("z")).where("packet_id = 'p0'")
    assert ("p0", "content_changed") in rows(D.dataset_problems(lines.where("position = 0"), changed, "prompt", inputs))


SELECTION = "packet_id string, split string, accession string, group_id string, source_path string, source_sha256 string, source_url string, cik string, filing_date string, standardized_format boolean, evidence array<string>, independence_review string"


def test_eligibility(spark):
    a = ("0000000001-23-000001", "0000000002-24-000001")
    good = ("p", "test", a[0], "g1", "data/raw/test/a", "h1", "u1", "1", "2023-05-01", False, None, "ok")
    form = ("q", "test", a[1], "g2", "data/raw/test/b", "h2", "u2", "2", "2024-05-01", True, ["Vote  CAST"], "ok")
    inv = spark.createDataFrame([("data/raw/test/a", "h1", [(a[0], "2023-05-01", "u1", "1")]), ("data/raw/test/b", "h2", [(a[1], "2024-05-01", "u2", "2")])],
                                "path string, sha256 string, locations array<struct<accession:string,filing_date:string,sec_url:string,cik:string>>")
    prior = spark.createDataFrame([("group", "old"), ("hash", "hx")], "kind string, key string")
    cells = spark.createDataFrame([("q", "The vote cast\nby us")], "packet_id string, text string")
    check = lambda *s: rows(D.eligibility_problems(spark.createDataFrame(list(s), SELECTION), inv, prior, cells, [2024]))
    assert check(good, form) == []
    assert check((*good[:3], "old", *good[4:])) == [("p", "known_before")]
    assert check(good, (*form[:3], "g1", *form[4:])) == [("p", "not_distinct"), ("q", "not_distinct")]
    assert check((*form[:10], ["absent"], "")) == [("q", "evidence_absent"), ("q", "independence")]
    assert check((*form[:9], False, [], "ok")) == [("q", "no_evidence")]
    assert check((good[0], "training", "x", *good[3:8], "2024-05-01", *good[9:])) == [("p", x) for x in ("identity", "no_evidence", "not_admitted", "storage")]
    assert ("p", "year") in check((*good[:8], "2022-05-01", *good[9:]))


def test_families(spark):
    prior = spark.createDataFrame([("a", ["family-x"], 1), ("b", ["Family"], 0)], "id string, family_ids array<string>, n_evidence int")
    expected = spark.createDataFrame([("a",), ("c",)], "id string")
    cand = spark.createDataFrame([("s1", "family-n", "1", ["h"], 1, 0), ("s2", "family-x", "2", ["h"], 0, 1)], "accession string, family_id string, cik string, sha256 array<string>, n_evidence int, foreign_evidence int")
    sel = spark.createDataFrame([("s1", "family-n", "1", "h"), ("s2", "family-x", "2", "h"), ("s3", "family-z", "3", "h")], "accession string, family_id string, cik string, source_sha256 string")
    assert rows(D.family_problems(prior, expected, cand, sel)) == [("b", "coverage"), ("b", "families"), ("b", "no_evidence"), ("c", "coverage"), ("s2", "family_overlaps"), ("s2", "foreign_evidence"), ("s2", "no_evidence"),
                                                                  ("s3", "differs_from_audit"), ("s3", "no_evidence")]


def test_drafts(spark):
    schema = "packet_id string, source_sha256 string, packet_version string, packet_fingerprint string, input_binding string"
    packets = spark.createDataFrame([(p, "s", "v", "f", "b") for p in "abcde"], schema)
    part = {k: "" for k in ("value", "raw_text", "origin", "evidence_input", "note")} | {"availability": "PRESENT"}
    whole = {f: dict(part) for f in D.CONTRACT}
    broken = whole | {"ticker": part | {"availability": "MAYBE"}}
    drafts = [("a", "s", "v", "f", "b", json.dumps(whole)), ("b", "s", "v", "g", "b", json.dumps(whole)), ("c", "s", "v", "f", "b", "{}"), ("d", "s", "v", "f", "b", json.dumps(broken)), ("z", "s", "v", "f", "b", json.dumps(whole))]
    assert rows(D.draft_problems(packets, spark.createDataFrame(drafts, schema + ", fields string"))) == [("b", "another_version"), ("c", "fields"), ("d", "unknown_state"), ("e", "no_draft"), ("z", "unknown_packet")]


def test_imports(spark):
    location = "struct<" + ",".join(f"{x}:string" for x in D.LOCATION) + ">"
    none = spark.createDataFrame([], f"sha256 string, path string, bytes long, locations array<{location}>, release string")
    files = spark.createDataFrame([("h", "a.htm", 5, f"u{i}", "f", "acc", None, None, None, None) for i in (1, 2, 1)] + [("k", "b.htm", 6, "u", *[None] * 6)], "sha256 string, path string, bytes long, " + ", ".join(f"{x} string" for x in D.LOCATION))
    once = D.imported(none, files)
    assert [(r.sha256, r.path, len(r.locations), r.release) for r in once.orderBy("sha256").collect()] == [("h", "a.htm", 2, "held"), ("k", "b.htm", 1, "held")]
    assert rows(D.imported(once.withColumn("release", F.lit("open")), files)) == rows(once.withColumn("release", F.lit("open")))
    assert rows(D.name_clashes(spark.createDataFrame([("A.htm",), ("a.htm",), ("a.htm",), ("b",)], "path string"))) == [("a.htm", 2)]


def test_acceptance_order_and_reviews(spark):
    packets = spark.createDataFrame([("p", "training"), ("q", "development"), ("r", "training")], "packet_id string, split string")
    named = spark.createDataFrame([(0, "r"), (1, "q"), (2, "p")], "place long, packet_id string")
    assert rows(D.accepted(named, packets).select("packet_id", "position")) == [("p", 1), ("q", 0), ("r", 0)]
    t = D.review_template(spark.createDataFrame([("c1", "b1")], "id string, answer_binding string")).first()
    assert (t.id, t.binding, t.subject_equivalent, t.quotation_errors) == ("c1", "b1", None, [])
    b = D.packet_binding({"b": 1, "a": "é"}, "v", "m")
    assert b["manifest_sha256"] == hashlib.sha256(encode({"a": "é", "b": 1}, "target").encode()).hexdigest() and len(set(b.values())) == 4
    assert D.answer_binding("i", {"id": 1}, {"text": "x"}) != D.answer_binding("i", {"id": 1}, {"text": "y"})


def test_context(spark):
    c = spark.createDataFrame([("p", 1, "acc", "me", bytearray(b"one\ntwo"), None, [(0, 3, "text"), (4, 7, "text")]), ("p", 2, "other", "me", bytearray(b"x"), None, [(0, 1, "text")]), ("p", 3, "acc", "", bytearray(b"x"), None, [(0, 1, "text")])],
                              "packet_id string, document_index int, accession string, association_review string, content binary, encoding string, spans array<struct<a:bigint,b:bigint,kind:string>>")
    found, refused = P.context_blocks(c, spark.createDataFrame([("p", "acc")], "packet_id string, own_accession string"))
    assert [(r.block_id, r.block.cells[0].text, r.block.line_start) for r in found.orderBy("block_id").collect()] == [("D1:B1", "one", 1), ("D1:B2", "two", 2)] and rows(refused) == [("p", 2), ("p", 3)]
