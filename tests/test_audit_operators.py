"""Rules, joins, ordered analytics, packets, holdout, sources and sinks on literal cases."""

import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import grams
from ledgerloom.functions import markup as M
from ledgerloom.functions import text as T
from ledgerloom.operators import answers as A
from ledgerloom.operators import holdout as H
from ledgerloom.operators import joins as J
from ledgerloom.operators import ordered as O
from ledgerloom.operators import packets as P
from ledgerloom.operators import rules as R
from ledgerloom.sources import files as S
from ledgerloom.sources import sinks as K

RAW = "<p>Größe</p>\n<p>left out</p>\n<tr><td>01</td><td colspan=2>A &amp; <b>B</b></td><td></td><td>For</td></tr>\n".encode()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_row_cells_keep_bytes():
    start, end = RAW.index(b"<tr"), RAW.index(b"</tr>") + 5
    found = M.block(RAW, start, end, "row")
    assert [c["text"] for c in found["cells"]] == ["01", "A & B", "", "For"] and found["cells"][1]["colspan"] == "2"
    assert RAW[found["cells"][1]["start_byte"] : found["cells"][1]["end_byte"]] == b"<td colspan=2>A &amp; <b>B</b></td>"
    assert (found["line_start"], found["line_end"]) == (3, 3) and found["source_slice_sha256"] == hashlib.sha256(RAW[start:end]).hexdigest()


@pytest.mark.parametrize("text,kind", [("<tr><td>a</td>x</tr>", "row"), ("<tr></tr>", "row"), ("<tr><tr><td>a</td></tr></tr>", "row"), ("<td colspan=0>a</td>", "cell"), ("<td><script>1</script></td>", "cell"),
                                       ("<p>a</p><p>b</p>", "block"), ("a\n\nb", "text"), ("a", "else"), ("<td>a", "cell")])
def test_refused(text, kind):
    with pytest.raises(M.Refused):
        M.block(text.encode(), 0, len(text), kind)


@pytest.mark.parametrize("markup,text", [
    ("a<br>b<BR/>c", "a b c"), ("a<p>b</p>c<li>d", "a b c d"), ("a<b>b</b><span title='x>y'>c</span>", "abc"), ("&lt;b&gt; &amp;amp; &#65;&nbsp;x", "<b> &amp; A x"), ("a<!-- <td> -->b<!DOCTYPE x>c<?pi?>d", "abcd"),
    ("1 < 2 > 0 & x<", "1 < 2 > 0 & x<"), ("<o:p>a</o:p><p:x>b", "ab"), ("</td>a</br>b", "ab"), ("", ""), ("\x1ca\x85b", "a b"), ("<a href=x", "<a href=x"),
])
def test_visible(markup, text):
    assert M.visible(markup) == text


def test_text_functions(spark):
    df = spark.createDataFrame([(" a\x1c b \x85c ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.collapse(F.col("t"))).collect()] == ["a b c", "", None]
    assert spark.createDataFrame([("Straße",), (None,)], "t string").select(T.casefold("t")).collect() == [("strasse",), (None,)]
    assert spark.createDataFrame([('a"é\n/',)], "t string").select(T.json_quoted(F.col("t"))).first()[0] == '"a\\"é\\n/"'
    assert spark.createDataFrame([("<a href='x'>&\"",)], "t string").select(T.html_escaped(F.col("t"))).first()[0] == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    shown = spark.createDataFrame([(3725.9,), (float("nan"),), (-1.0,)], "s double").select(T.duration(F.col("s"))).collect()
    assert [r[0] for r in shown] == ["1:02:05", None, None]
    assert spark.createDataFrame([("\x1b[31mred\x1b[0m\x1b]0;t\x07!\x00",)], "t string").select(T.plain_console(F.col("t"))).first()[0] == "red!"


def test_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id long, n int")
    found = R.violations(df, "id", [R.Rule("neg", F.col("n") < 0, "negative"), R.Rule("small", F.col("n") < 3, "small")])
    assert [r[:3] for r in rows(found)] == [("2", 0, "neg"), ("2", 1, "small")] and rows(R.first_violation(found))[0][:2] == ("2", "neg")
    with pytest.raises(R.Violated):
        R.require_empty(found)
    R.require_empty(found.where("false"))
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    assert rows(R.coverage(a, b, ["k"])) == [("x", 2, 1), ("z", 0, 1)] and rows(R.duplicates(a, "k")) == [("x", 2)]


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    new = spark.createDataFrame([("a", "1"), ("a", "1"), ("c", "3")], "k string, v string")
    merged, clash = J.merge(old, new, "k", "v")
    assert {tuple(r) for r in merged.collect()} == {("a", "1"), ("b", None), ("c", "3")} and clash.count() == 0
    assert J.merge(merged, new, "k", "v")[1].count() == 0
    assert rows(J.merge(old, spark.createDataFrame([("a", "2"), ("b", "1")], "k string, v string"), "k", "v")[1].select("k")) == [("a",), ("b",)]


def test_reached_by_any_key(spark):
    protected = spark.createDataFrame([("hash", "h1"), ("cik", "7")], "kind string, key string")
    c = spark.createDataFrame([(1, "h1", []), (2, "h2", ["7", "8"]), (3, "7", ["h1"]), (4, None, None)], "id long, h string, ciks array<string>")
    assert rows(J.reached(c, "id", {"hash": F.col("h"), "cik": F.col("ciks")}, protected)) == [(1,), (2,)]


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_quotations(spark, held):
    docs = [(1, "the one two three four end"), (2, "xone two three fourx"), (3, "one  two three four"), (4, None), (5, "ab"), (6, "a b one two three four a b one two three four"), (7, ""), (6, "b"), (None, "b")]
    items = [(1, "one two three four"), (2, "b"), (3, ""), (4, None), (5, "one two three four"), (6, "ne two three fou"), (7, "absent one two three words"), (5, "b"), (None, "b")]
    d, i = spark.createDataFrame(docs, "d long, t string").repartition(3), spark.createDataFrame(items, "i long, q string").repartition(2)
    want = sorted((a, b) for a, t in docs for b, q in items if t and q and q in t and a is not None and b is not None)
    assert rows(J.quotations_in(d, "d", "t", i, "i", "q", held=held)) == want
    assert rows(J.quotations_in(d, "d", "t", i.where("false"), "i", "q")) == rows(J.quotations_in(d.where("false"), "d", "t", i, "i", "q")) == []


def test_quotations_of_every_length(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é😀", k=rng.randrange(0, 400))) for _ in range(30)] + ["ab" * 300]
    quotes = [t[a : a + n] for t in texts for n in (1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 63, 64, 65, 127, 200) for a in [rng.randrange(0, max(1, len(t) - n + 1))]]
    quotes += [q[:-1] + "z" for q in quotes[::7]]
    d, i = spark.createDataFrame(list(enumerate(texts)), "d long, t string"), spark.createDataFrame(list(enumerate(quotes)), "i long, q string")
    want = sorted((a, b) for a, t in enumerate(texts) for b, q in enumerate(quotes) if q and q in t)
    assert rows(J.quotations_in(d, "d", "t", i, "i", "q")) == want == rows(J.quotations_in(d, "d", "t", i, "i", "q", rows=0))


def test_more_quotations_than_are_broadcast(spark):
    """Numbered passages, each in one of many texts; nothing but counts comes to the driver."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.concat(F.lit("passage number "), (F.col("id") * 50 + k).cast("string"), F.lit(" ends."))))
    docs = spark.range(200).select(F.col("id").alias("d"), text.alias("t"))
    items = spark.range(12_000).select(F.col("id").alias("i"), F.concat(F.lit("passage number "), F.col("id").cast("string"), F.lit(" ends")).alias("q"))
    found = J.quotations_in(docs, "d", "t", items, "i", "q", rows=100)
    assert rows(found) == sorted((k // 50, k) for k in range(10_000))


def test_passages_share_a_gram_with_their_texts():
    rng = random.Random(9)
    for _ in range(300):
        text = bytes(rng.choices(b"abc", k=rng.randrange(1, 500)))
        a = rng.randrange(0, len(text))
        part = text[a : a + rng.randrange(1, 200)]
        width = grams.width_of(len(part))
        own = set(grams.grams(part, width).tolist())
        assert own and own <= set(grams.grams(text, width).tolist())
    long = bytes(rng.choices(b"abcdefgh", k=3 * grams.STRETCH))
    for width in grams.GRAMS:
        for at in (grams.STRETCH - 33, 2 * grams.STRETCH - 1, len(long) - width):
            assert set(grams.grams(long[at : at + width], width).tolist()) <= set(grams.grams(long, width).tolist())


ranges = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ranges)
def test_overlap_and_gaps(spark, drawn):
    data = [("s", a, a + n, i) for i, (a, n) in enumerate(drawn)]
    df = spark.createDataFrame(data, "k string, a long, b long, i int")
    want = sorted(d[3] for d in data if any((e[1], e[3]) < (d[1], d[3]) and e[2] > d[1] for e in data))
    assert sorted(r.i for r in O.overlaps(df, ["k"], "a", "b", ["a", "i"]).collect()) == want
    held = {x for _, a, b, _ in data for x in range(a, b)}
    open_ = {x for _, a, b in O.gaps(df.withColumn("total", F.lit(50).cast("long")), ["k"], "a", "b", "total").collect() for x in range(a, b)}
    assert open_ == (set(range(50)) - held if data else set())


def test_windows(spark):
    df = spark.createDataFrame([("k", i, s, t) for i, (s, t) in enumerate([(20, 1), (5, 2), (5, 0)])], "k string, i int, s long, t long")
    assert [tuple(r)[4:] for r in O.rolling(df, ["k"], ["i"], {"sum": F.col("s")}, 2).orderBy("i").collect()] == [(1, 20), (2, 25), (2, 10)]
    assert [(r.later_seconds, r.later_updates, r.left) for r in O.remaining(df.withColumn("step", F.col("i") + 2), ["k"], ["i"], "s", "step", 10).orderBy("i").collect()] == [(20, 1, 8), (5, 1, 7), (10, 2, 6)]
    assert [r.i for r in O.not_increasing(df, ["k"], ["i"], "t").collect()] == [2]
    e = O.epoch(F.col("p"), [330, 660])
    at = spark.createDataFrame([(p,) for p in (0, 329, 330, 331, 659, 660, 661)], "p int").select("p", e["epoch"].alias("e"), e["done"].alias("d")).collect()
    assert [(r.e, r.d) for r in at] == [(1, 0), (1, 329), (1, 330), (2, 1), (2, 329), (2, 330), (None, None)]
    low = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 9, 1, 1, None, 1])], "k string, i int, v int")
    assert [r.below_count for r in O.runs_below(low, ["k"], ["i"], F.col("v") < 5).orderBy("i").collect()] == [1, 0, 1, 2, 0, 1]
    steps = spark.range(1, 9).where(O.scheduled(F.col("id"), 3, (4, 8)))
    assert [r.id for r in steps.collect()] == [3, 4, 6, 8]
    with pytest.raises(ValueError):
        O.epoch(F.col("p"), [5, 5])


def test_response_truth_table(spark):
    terminal = "struct<stop:boolean,truncated:boolean,tokens_evaluated:int,tokens_predicted:int,stop_type:string,timings:struct<cache_n:int,prompt_n:int>>"
    good = (True, False, 4, 2, "eos", (0, 4))
    cases = [([1, 9], good, False, False), ([1, 9], good, False, True), ([1, 9], None, False, False), ([1, 9], (*good[:5], (1, 4)), False, False), ([1], good, False, False),
             ([1, 2], good, False, False), ([1, 2], (True, False, 4, 2, "limit", (0, 4)), True, False), ([1, 9], good, True, False)]
    df = spark.createDataFrame(cases, f"t array<int>, e {terminal}, forced boolean, late boolean")
    got = df.select(A.assessed(F.col("t"), F.col("e"), prompt_length=F.lit(4), eos=F.lit(9), maximum=F.lit(2), forced=F.col("forced"), late=F.col("late"))).collect()
    assert [r[0] for r in got] == ["COMPLETE", "TIMEOUT", "CAPTURE_INCOMPLETE", "PROMPT_OR_CACHE_MISMATCH", "TOKEN_COUNT_MISMATCH", "TERMINATION_MISMATCH", "PROBE_COMPLETE", "PROBE_INCOMPLETE"]


def test_sequences(spark):
    df = spark.createDataFrame([([1, 2], [3, 9]), ([1] * 5, [9])], "p array<int>, a array<int>")
    s = A.sequence(F.col("p"), F.col("a"), F.lit(5))
    got = df.select(s["input_ids"].alias("i"), s["labels"].alias("l"), A.padded(s["attention_mask"], F.lit(6), 0).alias("m"), A.after_single_end(F.col("a"), 9).alias("e")).collect()
    assert tuple(got[0]) == ([1, 2, 3, 9], [-100, -100, 3, 9], [1, 1, 1, 1, 0, 0], [3, 9]) and got[1].i is None
    m = df.select(A.messages(F.lit("s"), F.lit("u"), F.lit("a")).alias("m")).select(A.roles_hold(F.col("m"))).first()[0]
    assert m is True


def packet(spark, spans, target, raw=RAW, sha=None):
    sha_ = hashlib.sha256(raw).hexdigest()
    one = [("p", "acc", "a/b.html", sha or sha_, "utf-8", "training", "g", spans, target, "yes", "me")]
    sources = spark.createDataFrame([("a/b.html", bytearray(raw), sha_, len(raw))], "path string, content binary, sha256 string, length long")
    return P.with_source(spark.createDataFrame(one, P.SELECTION), sources)


def test_packet(spark):
    p1, row = (0, RAW.index(b"\n")), (RAW.index(b"<tr"), RAW.index(b"</tr>") + 5)
    selected = packet(spark, [(*p1, "block"), (*row, "row")], row)
    assert R.violations(selected, "packet_id", P.selection_rules()).count() == 0
    found = P.packet_blocks(selected)
    text = P.model_inputs(found).first().model_input
    assert text == (f'B1 source bytes 0:{p1[1]}\n"Größe"\n[OMITTED SOURCE BYTES {p1[1]}:{row[0]}]\nBEGIN MARKED TARGET\nB2 source bytes {row[0]}:{row[1]}\n'
                    f'"01" | "A & B" colspan=2 | "" | "For"\nEND MARKED TARGET\n[OMITTED SOURCE BYTES {row[1]}:{len(RAW)}]')  # fmt: skip
    cells = P.source_cells(found)
    assert [r.text for r in cells.orderBy("block_index", "cell_index").collect()] == ["Größe", "01", "A & B", "", "For"]
    quotes = spark.createDataFrame([("p", "a", "A & B"), ("p", "b", "01A"), ("q", "c", "x"), ("p", "d", "")], "packet_id string, path string, quote string")
    assert [r.path for r in P.unsupported(quotes, cells).orderBy("path").collect()] == ["b", "c", "d"]


@pytest.mark.parametrize("spans,target,rule", [([], (0, 5), "spans"), ([(0, 5, "text"), (4, 9, "text")], (0, 5), "order"), ([(0, 5, "text")], (1, 5), "target"), ([(0, 5, "cell")], (0, 5), "target_kind"),
                                               ([(0, 5, "text"), (6, 9, "text")], (0, 9), "target"), ([(0, 10**6, "text")], (0, 10**6), "spans")])
def test_packet_rules(spark, spans, target, rule):
    assert rule in [r.rule_id for r in R.violations(packet(spark, spans, target), "packet_id", P.selection_rules()).collect()]
    if spans:
        assert [r.rule_id for r in R.violations(packet(spark, [(0, 5, "text")], (0, 5), sha="x"), "packet_id", P.selection_rules()).collect()] == ["source"]


def test_holdout(spark):
    a = spark.createDataFrame([("a", "training", "g1", False), ("b", "development", "g1", False), ("c", "training", "g2", True), ("d", "odd", "g3", False), ("e", "excluded", "g4", False), ("f", "test", "g4", False)],
                              "accession string, split string, group_id string, development_exposed boolean")
    assert rows(H.assignment_problems(a)) == [("a", "group_crosses_splits"), ("b", "group_crosses_splits"), ("c", "exposed_group_in_training"), ("d", "unknown_split")]
    s = spark.createDataFrame([("p", "f", "test", "g4", "h", (0, 5)), ("q", "f", "test", "g4", "h", (4, 9)), ("r", "f", "training", "g4", "h", (9, 12)), ("t", "zz", "test", "g", "k", (0, 5))],
                              "packet_id string, accession string, split string, group_id string, source_sha256 string, target struct<a:long,b:long>")
    assert rows(H.selection_problems(s, a)) == [("q", "target_overlaps"), ("r", "differs_from_assignment"), ("t", "differs_from_assignment")]
    ledger = spark.createDataFrame([("x", "gx", None, "7", ["h1"], ["alias"])], "accession string, group_id string, family_id string, cik string, sha256 array<string>, aliases array<string>")
    c = [("1", "training", "alias", "g", None, "h", "p", []), ("2", "training", "a", "g", "gx", "h", "p", []), ("3", "development", "a", "g", None, "h1", "p", []), ("4", "training", "a", "g", None, "h", "p", ["7"]),
         ("5", "training", "a", "g", None, "h", "data/raw/test/z", []), ("6", "training", "a", "g", None, "h", "p", ["8"]), ("7", "test", "x", "g", None, "h", "p", [])]
    df = spark.createDataFrame(c, "packet_id string, split string, accession string, group_id string, family_id string, source_sha256 string, source_path string, ciks array<string>")
    assert rows(H.protected_selections(df, ledger)) == [(k,) for k in "12345"]
    new = spark.createDataFrame([("x", "gx", "f", "7", ["h0"]), ("y", "gy", None, None, ["h9"])], "accession string, group_id string, family_id string, cik string, sha256 array<string>")
    merged, clash = H.reserve(ledger, new)
    assert {tuple(r[:4]) + (tuple(r.sha256),) for r in merged.collect()} == {("x", "gx", "f", "7", ("h0", "h1")), ("y", "gy", None, None, ("h9",))} and clash.count() == 0
    assert rows(H.reserve(ledger, new.withColumn("cik", F.lit("8")))[1]) == [("x",)]
    assert H.dropped_reservations(ledger, merged).count() == 0 and rows(H.dropped_reservations(merged, ledger)) == [("x",), ("y",)]
    years = spark.createDataFrame([("2023-05-01",), ("2024-05-01",)], "filing_date string")
    assert H.year_mismatch(years, [2024, 2023]).count() == 0 and rows(H.year_mismatch(years, [2023, 2023])) == [(2023, 1, 2), (2024, 1, 0)]
    ev = spark.createDataFrame([(1, bytearray(b"abcdef"), 1, 3, hashlib.sha256(b"bc").hexdigest()), (2, bytearray(b"abcdef"), 1, 4, hashlib.sha256(b"bc").hexdigest()), (3, None, 0, 1, "x")], "id int, content binary, a long, b long, slice_sha256 string")
    assert rows(H.evidence_problems(ev)) == [(2,), (3,)]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_bytes(b'{"a":1}\r\n{"a":1,"a":2}\n\n[2]\n')
    lines = S.json_lines(spark, f"file://{tmp_path}/d")
    assert [(r.position, r.ok) for r in lines.orderBy("position").collect()] == [(0, True), (1, False), (2, False), (3, True)]
    files = S.documents(spark, f"file://{tmp_path}/d", limit=5).collect()
    assert files[0].content is None and S.inventory(spark, f"file://{tmp_path}/d").first().bytes == 28
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "master.idx").write_bytes("CIK|Name|Form|Date|Path\n12|Ä|N-PX|2024-01-01|edgar/data/12/0001.txt\x0b013|B|N-PX/A|2024|a/b.c.txt\n1|x|10-K|d|p\n".encode("latin-1"))
    assert rows(S.read_index(spark, f"file://{tmp_path}/i").select("cik", "form", "accession")) == [("013", "N-PX/A", "b.c"), ("12", "N-PX", "0001")]
    tail = spark.createDataFrame([("f", 0, '{"a":1}'), ("f", 1, '{"a"'), ("g", 0, "{"), ("g", 1, '{"a":2}')], "path string, position int, value string")
    assert [(r.path, r.broken_before_end) for r in S.tolerant_tail(tail, "a int").orderBy("path", "position").collect()] == [("f", False), ("g", True), ("g", False)]
    sse = spark.createDataFrame([("f", 0, 'data: {"t":1}'), ("f", 1, ": ping"), ("f", 2, "data: [DONE]"), ("f", 3, 'data: {"t":2}')], "path string, position int, value string")
    assert [(r.position, r.event.t) for r in S.server_events(sse, "t int").collect()] == [(0, 1)]


def test_predicates(spark):
    urls = ["https://www.a.org/x", "https://www.a.org:443/x", "http://www.a.org/x", "https://u@www.a.org/", "https://www.a.org:8443/", "https://www.a.org.evil.com/", "https://WWW.A.ORG", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(S.url_allowed(F.col("u"), ("www.a.org",))).collect()] == [True, True, False, False, False, False, True, False]
    names = spark.createDataFrame([("a-1.htm",), ("con.txt",), ("A.htm",), ("a.",), (None,)], "n string").select(S.portable_name(F.col("n"))).collect()
    assert [r[0] for r in names] == [True, False, False, False, False]
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("..",), ("a..b/c",)], "p string").select(S.relative_path(F.col("p"))).collect()
    assert [r[0] for r in paths] == [True, False, False, False, True]
    key, differ = S.registrant(F.col("c"), F.col("u"))
    got = spark.createDataFrame([("0012", "/data/12/"), (None, "x/Data/0007/y"), ("3", "/data/4/"), (None, "none")], "c string, u string").select(key, differ).collect()
    assert [tuple(r) for r in got] == [("12", False), ("7", False), ("3", True), (None, False)]
    pages = spark.createDataFrame([(bytearray(b"<html>File Unavailable"),), (bytearray(b"<SEC-DOCUMENT> x"),), (bytearray(b"<SEC-DOCUMENT></SEC-DOCUMENT>"),)], "c binary").select(S.fetch_problem(F.col("c"))).collect()
    assert [r[0] for r in pages] == ["failure_page", "cut_short", None]


def test_publish(spark, tmp_path):
    data = [(s, i, f"{s}{i}") for s in ("training", "development") for i in range(20)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "split string, position int, row string").repartition(4)
    at = f"{tmp_path}/out"
    manifest = K.publish(df, at)
    assert {k: v["rows"] for k, v in manifest["files"].items()} == {"training": 20, "development": 20}
    assert [r.value for r in spark.read.text(f"{at}/split=training").collect()] == [f"training{i}" for i in range(20)]
    with pytest.raises(K.Exists):
        K.publish(df, at)
    K.append_ledger(spark.createDataFrame([("x", 1.5)], "status string, elapsed_seconds double"), f"{tmp_path}/ledger")
    K.append_ledger(spark.createDataFrame([("STARTED", -1.0)], "status string, elapsed_seconds double"), f"{tmp_path}/ledger")
    ledger = K.read_ledger(spark, f"{tmp_path}/ledger", "status string, elapsed_seconds double")
    assert sorted(r.rule_id for r in R.violations(ledger, "status", S.ledger_rules()).collect()) == ["seconds", "started"]
    K.ordered_lines(df, f"{tmp_path}/lines", "position", "row")
    assert [r.value[-2:] for r in spark.read.text(f"{tmp_path}/lines").collect()][-1].endswith("19")
