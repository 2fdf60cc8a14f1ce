"""The native label rules find what the rules over trees find."""

import copy
import json
import random

from pyspark.sql import functions as F

from ledgerloom.functions.canonical import strict_variant
from ledgerloom.operators import labels as L
from tests.test_labels_and_scoring import absent, field, mixed

VALUES = (None, "", "OTHER", "FOR", 5, True, 1.5, [], {}, "PRESENT", "NOT_APPLICABLE", "DERIVED", "DID_NOT_VOTE", "2024-02-30", "2024-2-3", [None], [field("x")], "FUND_GROUP", {"fields": 1})


def places(node, at=()):
    yield at
    items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    for k, v in items:
        yield from places(v, (*at, k))


def changed(label, rng):
    """The label with one node replaced, dropped or added."""
    label = copy.deepcopy(label)
    path = rng.choice(list(places(label)))
    if not path:
        return rng.choice(VALUES)
    node = label
    for k in path[:-1]:
        node = node[k]
    what = rng.random()
    if what < 0.1 and isinstance(node, dict):
        del node[path[-1]]
    elif what < 0.2 and isinstance(node, dict):
        node["extra"] = 1
    else:
        node[path[-1]] = copy.deepcopy(rng.choice(VALUES))
    return label


def labels(n=400):
    rng = random.Random(2)
    nonvote = absent()
    nonvote["fields"]["participation"] = field("DID_NOT_VOTE")
    nonvote["fields"]["vote_components"] = {"value": [], "raw_text": None, "availability": "NOT_APPLICABLE", "origin": "DERIVED"}
    out = [absent(), mixed(), nonvote, [], None, 3, {"fields": 3}, {"fields": {}, "x": 1}]
    for _ in range(n):
        label = rng.choice([mixed(), nonvote])
        for _ in range(rng.choice([1, 1, 2, 4])):
            label = changed(label, rng)
        out.append(label)
    return out


def test_columns_find_what_trees_show(spark):
    told = [json.dumps(x, ensure_ascii=False) for x in labels()] + ["{", "", '{"a":1,"a":2}', "NaN", None]
    rows = spark.createDataFrame(list(enumerate(told)), "i int, t string").repartition(4).select("i", L.label_problems(F.col("t")).alias("p")).collect()
    got = {r.i: [tuple(x) for x in r.p] for r in rows}
    for i, t in enumerate(told[:-5]):
        assert got[i] == list(L.problems(json.loads(t))), t
    assert all(got[i] == [("label", "json")] for i in range(len(told) - 5, len(told)))
    sound = spark.createDataFrame(list(enumerate(told)), "i int, t string").repartition(4).select("i", L._of(strict_variant(F.col("t")), L.is_sound).alias("ok")).collect()
    assert {r.i for r in sound if r.ok} == {i for i, p in got.items() if not p}
    assert sum(not p for p in got.values()) > 20 and len({r for p in got.values() for _, r in p}) >= 10


def wordings(node, at=""):
    if isinstance(node, dict):
        yield from [(at, node["raw_text"])] if node.get("raw_text") else []
        for k in node.keys() - {"raw_text"}:
            yield from wordings(node[k], f"{at}.{k}" if at else k)
    elif isinstance(node, list):
        for i, x in enumerate(node):
            yield from wordings(x, f"{at}[{i}]")


def test_quotations_and_review_texts(spark):
    sound = [x for x in labels() if not list(L.problems(x))]
    df = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(sound)], "i int, t string")
    got = sorted((r.i, r.path, r.quote) for r in L.quotations(df, "i", "t").collect())
    assert got == sorted((i, p, q) for i, x in enumerate(sound) for p, q in wordings(x["fields"])) and got
    fields = L.review_fields(df, "i", "t")
    back, wrong = L.from_review(fields, "i")
    assert {r.i: json.loads(r.label) for r in back.collect()} == dict(enumerate(sound)) and wrong.count() == 0


def test_review_texts_that_spell_no_label(spark):
    df = spark.createDataFrame([(i, json.dumps(mixed())) for i in range(7)], "i int, t string")
    f = L.review_fields(df, "i", "t").withColumn("at", F.concat("i", F.lit(":"), "field"))
    f = f.where("at <> '1:ticker'")  # missing
    changed = F.when(F.col("at") == "2:ticker", "{").when(F.col("at") == "3:meeting_date", '"2024-02-30"').otherwise(F.col("value"))
    f = f.withColumn("value", changed).withColumn("field", F.when(F.col("at") == "4:ticker", "other").when(F.col("at") == "5:ticker", "issuer_name").otherwise(F.col("field")))
    f = f.withColumn("origin", F.when(F.col("at") == "6:issuer_name", None).otherwise(F.col("origin")))
    good, wrong = L.from_review(f.drop("at"), "i")
    assert [r.i for r in good.collect()] == [0]
    assert sorted(map(tuple, wrong.collect())) == [(1, "fields", "keys"), (2, "ticker", "json"), (3, "meeting_date", "not_a_calendar_date"), (4, "fields", "keys"), (5, "label", "json"), (6, "issuer_name", "no_origin")]


def test_field_at(spark):
    label = json.dumps(mixed())
    paths = ["fields.vote_components.value[0].quantity.value.amount.value", "fields.ticker.value", "fields.nothing", "ticker"]
    df = spark.createDataFrame([(label, p) for p in paths], "t string, p string")
    assert [r[0] for r in df.select(F.to_json(L.field_at(F.col("t"), F.col("p")))).collect()] == ['"007"', '""', None, None]
