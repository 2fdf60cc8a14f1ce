"""Packets, gates, sources and sinks over the driver tables, with their SQL.

Rows of the tables stand for records; where a rule needs broken ones, a row's number says how it is spoilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical, text
from ..operators import answers, datasets, holdout, ordered, packets, rules, runs
from ..operators.scan import Fold, running
from ..sources import files, sinks
from ..sources.scratch import shared
from ..streaming import events as event_streams
from .audit import query

c = F.col


def _by_rule(found: DataFrame, key: str, as_long: bool = True) -> DataFrame:
    """Violations as (key, rule)."""
    return found.select((c("entity_id").cast("long") if as_long else c("entity_id")).alias(key), c("rule_id").alias("rule"))


# Packets: a document's first line is one range, the rest another; the rest is the target.

_CUT = "cut AS (SELECT doc_id, text, source, octet_length(encode(text)) AS size, octet_length(encode(string_split(text, chr(10))[1])) AS pos FROM documents WHERE contains(text, chr(10)))"


def _packets(t) -> DataFrame:
    raw = c("text").cast("binary")
    docs = t("documents").where(F.contains("text", F.lit("\n"))).select("doc_id", "source", raw.alias("content"), F.octet_length("text").cast("long").alias("length"), F.octet_length(F.get(F.split("text", "\n"), F.lit(0))).cast("long").alias("at"))
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.lit("text").alias("kind"))
    zero = F.lit(0).cast("long")
    return docs.select(
        c("doc_id").cast("string").alias("packet_id"), "content", "length", F.lit("utf-8").alias("encoding"), F.sha2("content", 256).alias("source_sha256"), c("source").alias("accession"), "at",
        F.when(c("at") > 0, F.array(span(zero, c("at")), span(c("at") + 1, c("length")))).otherwise(F.array(span(c("at") + 1, c("length")))).alias("spans"), F.struct((c("at") + 1).alias("a"), c("length").alias("b")).alias("target"),
    ).where("at + 1 < length")


_PARAGRAPHS = "NOT contains(trim(regexp_replace(text[length(string_split(text, chr(10))[1]) + 2:], '^[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+|[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+$', '', 'g')), chr(10) || chr(10))"


@query(f"""WITH {_CUT}, k AS (SELECT *, string_split(text, chr(10))[1] AS head, text[length(string_split(text, chr(10))[1]) + 2:] AS body FROM cut WHERE pos + 1 < size AND {_PARAGRAPHS})
SELECT doc_id::VARCHAR AS packet_id, sha256((CASE WHEN pos > 0 THEN 'B1 source bytes 0:' || pos || chr(10) || to_json(head)::VARCHAR || chr(10) ELSE '' END) || '[OMITTED SOURCE BYTES ' || pos || ':' || (pos + 1) || ']' || chr(10)
  || 'BEGIN MARKED TARGET' || chr(10) || (CASE WHEN pos > 0 THEN 'B2' ELSE 'B1' END) || ' source bytes ' || (pos + 1) || ':' || size || chr(10) || to_json(body)::VARCHAR || chr(10) || 'END MARKED TARGET') AS input_sha256 FROM k""")
def packet_inputs(t):
    """What a model is given of every document of two or more lines whose rest is one paragraph."""
    found = packets.packet_blocks(_packets(t))
    whole = found.groupBy("packet_id").agg(F.count_if(c("block.error").isNotNull()).alias("refused")).where("refused = 0").select("packet_id")
    return packets.model_inputs(found.join(whole, "packet_id", "left_semi")).select("packet_id", F.sha2("model_input", 256).alias("input_sha256"))


@query(f"""WITH {_CUT}, k AS (SELECT *, string_split(text, chr(10))[1] AS head, text[length(string_split(text, chr(10))[1]) + 2:] AS body FROM cut WHERE pos + 1 < size)
SELECT doc_id::VARCHAR AS packet_id, 0 AS block_index, 0 AS cell_index, sha256(head) AS text_sha256, 0::BIGINT AS start_byte, pos::BIGINT AS end_byte FROM k WHERE pos > 0
UNION ALL SELECT doc_id::VARCHAR, CASE WHEN pos > 0 THEN 1 ELSE 0 END, 0, sha256(body), pos + 1, size FROM k WHERE {_PARAGRAPHS}""")
def packet_cells(t):
    cells = packets.source_cells(packets.packet_blocks(_packets(t)))
    return cells.select("packet_id", "block_index", "cell_index", F.sha2("text", 256).alias("text_sha256"), "start_byte", "end_byte")


@query(f"""WITH {_CUT} SELECT doc_id::VARCHAR AS packet_id, sha256('["' || source || '","' || sha256(text) || '",[' || (pos + 1) || ',' || size || ']]') AS target_id FROM cut WHERE pos + 1 < size""")
def target_ids(t):
    return _packets(t).select("packet_id", packets.target_ids().alias("target_id"))


@query(f"""WITH {_CUT} SELECT doc_id::VARCHAR AS packet_id, size - pos - 1 AS bytes, pos % 3 = 0 AS broken FROM cut WHERE pos + 1 < size AND pos % 3 = 0""")
def evidence_hashes(t):
    """The target's bytes as evidence; where the first line's length is a multiple of three, the hash is another's."""
    p = _packets(t)
    held = F.sha2(F.substring(c("content"), (c("target.a") + 1).cast("int"), (c("target.b") - c("target.a")).cast("int")), 256)
    ev = p.select(c("packet_id").alias("id"), "content", c("target.a").alias("a"), c("target.b").alias("b"), F.when(c("at") % 3 == 0, F.reverse(F.concat(held, F.lit("z")))).otherwise(held).alias("slice_sha256"))
    bad = holdout.evidence_problems(ev).select(c("id").alias("packet_id"))
    return bad.join(p.select("packet_id", (c("target.b") - c("target.a")).alias("bytes"), (c("at") % 3 == 0).alias("broken")), "packet_id")


@query("SELECT doc_id AS id FROM documents WHERE n_chars % 5 = 0 OR n_chars = 0")
def frozen_evidence(t):
    """Documents as frozen evidence without content; some have a hash in upper case."""
    h = F.sha2("text", 256)
    ev = t("documents").select(c("doc_id").alias("id"), F.lit(0).alias("a"), c("n_chars").alias("b"), F.when(c("n_chars") % 5 == 0, F.concat(F.lit("A"), F.substring(h, 2, 63))).otherwise(h).alias("slice_sha256"))
    return holdout.evidence_problems(ev, frozen=True)


@query(f"""WITH {_CUT}, x AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
SELECT doc_id::VARCHAR AS packet_id, sha256((CASE WHEN title <> '' THEN 'D1:B1 source bytes 0:' || octet_length(encode(title)) || chr(10) || to_json(title)::VARCHAR || chr(10) || '[OMITTED D1 SOURCE BYTES ' || octet_length(encode(title)) || ':' || (octet_length(encode(title)) + 1) || ']' || chr(10) ELSE '' END)
  || 'BEGIN MARKED TARGET' || chr(10) || (CASE WHEN title <> '' THEN 'D2:' ELSE '' END) || 'B1 source bytes 0:' || pos || chr(10) || to_json(string_split(text, chr(10))[1])::VARCHAR || chr(10) || 'END MARKED TARGET' || chr(10) || '[OMITTED SOURCE BYTES ' || pos || ':' || size || ']') AS input_sha256
FROM cut JOIN x ON page_id = doc_id WHERE pos > 0""")
def packet_contexts(t):
    """First lines as targets, with the title of the page of the same number as another document of the filing."""
    p = _packets_of_first_lines(t)
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = t("pages").select(c("page_id").cast("string").alias("packet_id"), title.alias("title"), F.lit(1).alias("document_index"), F.lit("a").alias("accession"), F.lit("me").alias("association_review"), F.lit("utf-8").alias("encoding"))
    contexts = pages.select("packet_id", "document_index", "accession", "association_review", "encoding", F.concat("title", F.lit("!")).cast("binary").alias("content"),
                            F.when(c("title") != "", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("title").cast("long").alias("b"), F.lit("text").alias("kind")))).alias("spans"))
    p = p.join(pages.select("packet_id"), "packet_id", "left_semi")
    told, _ = packets.context_blocks(contexts, p.select("packet_id", F.lit("a").alias("own_accession")))
    return packets.model_inputs(packets.packet_blocks(p), told).select("packet_id", F.sha2("model_input", 256).alias("input_sha256"))


def _packets_of_first_lines(t) -> DataFrame:
    at = F.octet_length(F.get(F.split("text", "\n"), F.lit(0))).cast("long")
    docs = t("documents").where(F.contains("text", F.lit("\n")) & (at > 0)).withColumn("at", at)
    zero = F.lit(0).cast("long")
    return docs.select(c("doc_id").cast("string").alias("packet_id"), c("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"), F.lit("utf-8").alias("encoding"),
                       F.array(F.struct(zero.alias("a"), c("at").alias("b"), F.lit("text").alias("kind"))).alias("spans"), F.struct(zero.alias("a"), c("at").alias("b")).alias("target"))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents) SELECT doc_id, 'path' AS rule FROM d WHERE k = 1 UNION ALL SELECT doc_id, 'source' FROM d WHERE k = 2 UNION ALL SELECT doc_id, 'partition' FROM d WHERE k = 3
UNION ALL SELECT doc_id, 'review' FROM d WHERE k = 4 UNION ALL SELECT doc_id, 'target_kind' FROM d WHERE k = 5""")
def selection_checks(t):
    """Documents as selections of their whole text, spoilt in five ways."""
    k, n = c("doc_id") % 6, F.octet_length("text").cast("long") + 1
    s = t("documents").select(
        "doc_id", F.when(k == 1, "a/../b").otherwise("a/b").alias("source_path"), F.lit("h").alias("source_sha256"), F.when(k == 2, F.lit("x")).otherwise("h").alias("sha256"), n.alias("length"), F.when(k == 3, "odd").otherwise("training").alias("split"),
        F.lit("yes").alias("boundary_review"), F.when(k == 4, "").otherwise("me").alias("reviewer"), F.array(F.struct(F.lit(0).cast("long").alias("a"), n.alias("b"), F.when(k == 5, "cell").otherwise("row").alias("kind"))).alias("spans"),
        F.struct(F.lit(0).cast("long").alias("a"), n.alias("b")).alias("target"),
    )
    return _by_rule(rules.violations(s, "doc_id", packets.selection_rules()), "doc_id")


@query("""WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer) SELECT o_orderkey::VARCHAR AS packet_id, 'differs_from_assignment' AS rule FROM orders LEFT JOIN a ON c_custkey = o_custkey + 1
WHERE c_custkey IS NULL OR c_mktsegment <> 'BUILDING' UNION ALL SELECT packet_id, 'target_overlaps' FROM (SELECT o_orderkey::VARCHAR AS packet_id, o_orderkey % 50 AS a, max(o_orderkey % 50 + o_custkey % 3 + 1)
  OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50, o_orderkey % 50 + o_custkey % 3 + 1, o_orderkey::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM orders) WHERE reach > a""")
def selection_assignments(t):
    """Orders as selections of their customer's source, the next customer's segment as the split that it should have."""
    a = c("o_orderkey") % 50
    selections = t("orders").select(c("o_orderkey").cast("string").alias("packet_id"), (c("o_custkey") + 1).alias("accession"), F.lit("BUILDING").alias("split"), F.lit("g").alias("group_id"), c("o_custkey").cast("string").alias("source_sha256"),
                                    F.struct(a.alias("a"), (a + c("o_custkey") % 3 + 1).alias("b")).alias("target"))
    known = t("customer").select(c("c_custkey").alias("accession"), c("c_mktsegment").alias("split"), F.lit("g").alias("group_id"))
    return holdout.selection_problems(selections, known)


# Bindings.


@query("""SELECT doc_id AS packet_id, 'review-binding-v1' AS binding_version, sha256('{"a":' || to_json(source)::VARCHAR || ',"z":' || n_chars || '}') AS manifest_sha256, sha256(lang) AS review_view_sha256, sha256(text) AS model_input_sha256 FROM documents""")
def review_bindings(t):
    """Three hashes of each document as a packet; its manifest's keys stand in another order than they are hashed in."""
    manifest = F.concat(F.lit('{"z": '), "n_chars", F.lit(', "a": '), text.json_quoted(c("source")), F.lit("}"))
    return datasets.packet_bindings(t("documents").select(c("doc_id").alias("packet_id"), manifest.alias("manifest"), c("lang").alias("source_view"), c("text").alias("model_input")))


@query("""SELECT conv_id * 1000 + turn AS id, sha256('{"answer": {"status": "COMPLETE", "text": ' || to_json(text)::VARCHAR || '}, "case": {"id": ' || conv_id || ', "role": "' || role || '"}, "identity": "run"}') AS answer_binding FROM conversations""")
def answer_bindings(t):
    turns = t("conversations").select(
        (c("conv_id") * 1000 + c("turn")).alias("id"), F.concat(F.lit('{"role":"'), "role", F.lit('","id":'), "conv_id", F.lit("}")).alias("case_json"), F.concat(F.lit('{"text":'), text.json_quoted(c("text")), F.lit(',"status":"COMPLETE"}')).alias("answer_json")
    )
    return datasets.answer_bindings(turns, "run")


@query("""WITH v AS (SELECT p_partkey, '"' || p_name || '"' AS n, p_size AS s FROM part)
SELECT p_partkey, sha256('{"a":[' || n || ',null],"z":' || s || '}') AS target, sha256('{"a": [' || n || ', null], "z": ' || s || '}') AS binding, sha256('{"z": ' || s || ', "a": [' || n || ', null]}') AS row, sha256('{"a":[' || n || ',null],"z":' || s || '}') AS draft FROM v""")
def canonical_hashes(t):
    """Hashes of one value in its four encodings."""
    told = F.concat(F.lit('{ "z":'), "p_size", F.lit(' ,"a":["'), "p_name", F.lit('" ,null]}'))
    return t("part").select("p_partkey", *[canonical.parsed(told, form)["sha256"].alias(form) for form in canonical.FORMS])


@query("""SELECT source, count(*) AS files, sha256('{' || string_agg('"' || doc_id || '": "' || sha256(text) || '"', ', ' ORDER BY doc_id::VARCHAR) || '}') AS inventory_sha256 FROM documents GROUP BY source""")
def inventory_hashes(t):
    return runs.inventory_hash(t("documents").select("source", c("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")), ["source"])


# Gates.


@query("""WITH e AS (SELECT source, list(doc_id::VARCHAR ORDER BY doc_id) AS ids FROM documents GROUP BY source), p AS (SELECT doc_id::VARCHAR AS id, source, lang, n_chars FROM documents)
SELECT source AS approval_id, 'review_changed' AS rule FROM e WHERE len(ids) % 2 = 0 UNION ALL SELECT source, 'no_reviewer' FROM e WHERE len(ids) % 3 = 0 UNION ALL SELECT source, 'packet_twice' FROM e
UNION ALL SELECT DISTINCT source, 'not_reviewed' FROM p WHERE lang = 'de' UNION ALL SELECT DISTINCT source, 'binding_changed' FROM p WHERE lang <> 'de' AND n_chars % 7 = 0""")
def acceptance_gate(t):
    """An approval for each source, which names its first document twice."""
    docs = t("documents")
    n = c("n")
    approvals = docs.groupBy("source").agg(F.count("*").alias("n")).select(
        c("source").alias("approval_id"), F.lit("ACCEPTED").alias("decision"), F.lit("h").alias("export_sha256"), F.when(n % 2 == 0, "x").otherwise("h").alias("review_sha256"), F.when(n % 3 == 0, "").otherwise("me").alias("reviewer"), F.lit("2024-02-29").alias("accepted_at"),
    )
    one = lambda df: df.select(c("source").alias("approval_id"), c("doc_id").alias("place"), c("doc_id").cast("string").alias("packet_id"))
    named = one(docs).unionByName(one(docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"))))
    packs = docs.select(c("doc_id").cast("string").alias("packet_id"), (c("lang") != "de").alias("reviewed"), F.lit("b").alias("input_binding"), F.when(c("n_chars") % 7 == 0, "z").otherwise("b").alias("rebuilt_binding"))
    return runs.acceptance_problems(approvals, named, packs)


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey % 3 AS a, c_nationkey % 2 AS b, c_nationkey % 5 AS n FROM customer)
SELECT id, 'schema' AS rule FROM p WHERE b = 1 UNION ALL SELECT id, 'scorer' FROM p WHERE a = 1 UNION ALL SELECT id, 'years' FROM p WHERE a = 0 UNION ALL SELECT id, 'count' FROM p WHERE n <> 2 UNION ALL SELECT id, 'subset' FROM p WHERE a = 2""")
def protocol_checks(t):
    a, b = c("c_nationkey") % 3, c("c_nationkey") % 2
    p = t("customer").select(
        c("c_custkey").alias("id"), F.when(b == 1, "v0").otherwise("v1").alias("schema"), F.when(a == 1, "old").otherwise("s").alias("scorer_version"), (c("c_nationkey") % 5).alias("examples"),
        F.when(a == 0, F.array(F.lit(2020), F.lit(2020))).otherwise(F.array(F.lit(2020), F.lit(2021))).alias("filing_years"), F.when(a == 2, F.array(F.lit(2022))).otherwise(F.array(F.lit(2020))).alias("standardized_years"),
    )
    return _by_rule(rules.violations(p, "id", runs.protocol_rules("v1", "s")), "id")


_ACCESSION = "lpad(o_custkey::VARCHAR, 10, '0') || '-' || right(year(o_orderdate)::VARCHAR, 2) || '-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0')"


@query(f"""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS cik, o_orderkey % 7 AS k, year(o_orderdate) IN (1995, 1997) AS formed, o_orderkey % 11 AS e, {_ACCESSION} AS accession FROM orders), n AS (SELECT cik, count(*) AS n FROM o GROUP BY 1)
SELECT id, 'storage' AS rule FROM o WHERE k = 1 UNION ALL SELECT id, 'not_admitted' FROM o WHERE k IN (1, 2, 3) OR cik IS NULL UNION ALL SELECT id, 'year' FROM o WHERE k = 3 AND accession NOT LIKE '%-99-%' UNION ALL SELECT id, 'independence' FROM o WHERE k = 4
UNION ALL SELECT id, 'known_before' FROM o WHERE cik < 100 UNION ALL SELECT id, 'not_distinct' FROM o JOIN n USING (cik) WHERE n > 1 UNION ALL SELECT id, 'identity' FROM o WHERE cik IS NULL
UNION ALL SELECT id, 'no_evidence' FROM o WHERE k <> 3 AND formed AND e IN (1, 2) UNION ALL SELECT id, 'evidence_absent' FROM o WHERE k <> 3 AND formed AND e IN (3, 4)""")
def eligibility(t):
    """Orders as test selections of their customer: some stored elsewhere, from another year, of a customer known before or of none.

    Two years are of the standardized form: there some have no evidence, or evidence that their cells don't hold."""
    k, e = c("o_orderkey") % 7, c("o_orderkey") % 11
    year = F.year("o_orderdate").cast("string")
    # All digits but the year's are the order's number: no two orders share an accession, so that only customers are not distinct.
    number = F.lpad(c("o_orderkey").cast("string"), 16, "0")
    accession = F.when(c("o_custkey").isNotNull(), F.concat(F.left(number, F.lit(10)), F.lit("-"), F.right(year, F.lit(2)), F.lit("-"), F.right(number, F.lit(6))))
    o = t("orders").withColumn("accession", accession).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    path, key = F.concat(F.lit("data/raw/test/"), "o_orderkey"), F.when(c("o_orderkey") % 13 != 0, c("o_custkey").cast("string"))
    locations = F.array(F.struct("accession", c("day").alias("filing_date"), F.lit("u").alias("sec_url"), key.alias("cik")))
    inventory = o.select(path.alias("path"), c("o_orderkey").cast("string").alias("sha256"), locations.alias("locations"))
    # Evidence in another case and with other spaces than in the cell; absent evidence; an empty one; none.
    said = F.concat(F.lit(" \n"), F.lower("o_orderpriority"))
    evidence = F.when(e == 2, F.array().cast("array<string>")).when(e == 3, F.array(said, F.lit("nowhere"))).when(e == 4, F.array(F.lit(" "))).otherwise(F.array(said, F.lit("Order")))
    selections = o.select(
        c("o_orderkey").cast("string").alias("packet_id"), F.lit("test").alias("split"), "accession", c("o_orderkey").cast("string").alias("group_id"), F.when(k == 1, "data/raw/x").otherwise(path).alias("source_path"), c("o_orderkey").cast("string").alias("source_sha256"),
        F.when(k == 2, "v").otherwise("u").alias("source_url"), key.alias("cik"), F.when(k == 3, F.lit("2099-01-01")).otherwise(c("day")).alias("filing_date"), (e != 1).alias("standardized_format"), evidence.alias("evidence"),
        F.when(k == 4, "").otherwise("ok").alias("independence_review"),
    )
    prior = t("customer").where("c_custkey < 100").select(F.lit("cik").alias("kind"), c("c_custkey").cast("string").alias("key"))
    cells = o.select(c("o_orderkey").cast("string").alias("packet_id"), F.explode(F.array(F.lit("an  order"), F.concat(F.lit("Its priority:\t"), "o_orderpriority"))).alias("text"))
    return datasets.eligibility_problems(selections, inventory, prior, cells, [1995, 1997]).select(c("packet_id").cast("long").alias("id"), "rule")


@query("""WITH s AS (SELECT s_suppkey::VARCHAR AS id, s_nationkey AS f, s_suppkey % 4 AS k FROM supplier), n AS (SELECT f, count(*) AS n FROM s GROUP BY f)
SELECT id, 'differs_from_audit' AS rule FROM s WHERE k = 1 UNION ALL SELECT id, 'family_overlaps' FROM s JOIN n USING (f) WHERE n > 1 OR f < 3 UNION ALL SELECT id, 'no_evidence' FROM s WHERE k = 2 UNION ALL SELECT id, 'foreign_evidence' FROM s WHERE k = 3
UNION ALL SELECT 'n' || n_nationkey, 'families' FROM nation WHERE n_nationkey = 2 UNION ALL SELECT 'n' || n_nationkey, 'coverage' FROM nation WHERE n_nationkey >= 3""")
def family_audit(t):
    """Suppliers as candidates whose nation is their family; nations are prior sources, of which three are audited."""
    k = c("s_suppkey") % 4
    nation = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), "n_nationkey")
    prior = nation.where("n_nationkey < 3").select("id", F.array(F.when(c("n_nationkey") == 2, "Family").otherwise(F.concat(F.lit("family-"), "n_nationkey"))).alias("family_ids"), F.lit(1).alias("n_evidence"))
    prior = prior.withColumn("family_ids", F.when(c("id") == "n2", F.array(F.lit("Family"), F.lit("family-2"))).otherwise(c("family_ids")))
    s = t("supplier").select(c("s_suppkey").cast("string").alias("accession"), F.concat(F.lit("family-"), "s_nationkey").alias("family_id"), F.lit("1").alias("cik"), c("s_name").alias("source_sha256"), k.alias("k"))
    candidates = s.select("accession", "family_id", F.when(c("k") == 1, "2").otherwise("1").alias("cik"), F.array("source_sha256").alias("sha256"), F.when(c("k") == 2, 0).otherwise(1).alias("n_evidence"), F.when(c("k") == 3, 1).otherwise(0).alias("foreign_evidence"))
    return datasets.family_problems(prior, nation.select("id"), candidates, s.drop("k"))


def _reservations(t):
    ledger = t("documents").groupBy("source").agg(F.array_sort(F.collect_set(F.sha2("text", 256))).alias("sha256"))
    ledger = ledger.select(c("source").alias("accession"), F.lit("g").alias("group_id"), F.lit(None).cast("string").alias("family_id"), F.lit("1").alias("cik"), "sha256")
    new = t("conversations").select(F.concat(F.lit("src"), c("conv_id") % 30).alias("accession"), F.lit("g").alias("group_id"), F.lit(None).cast("string").alias("family_id"), F.when(c("conv_id") % 30 == 1, "2").otherwise("1").alias("cik"), F.array(F.sha2("text", 256)).alias("sha256"))
    return ledger, new


@query("""WITH l AS (SELECT source AS accession, sha256(text) AS h FROM documents), n AS (SELECT 'src' || (conv_id % 30) AS accession, sha256(text) AS h FROM conversations),
b AS (SELECT accession, h FROM l UNION SELECT n.accession, h FROM n WHERE n.accession <> 'src1' OR NOT EXISTS (SELECT 1 FROM l WHERE l.accession = 'src1'))
SELECT accession, count(*) AS hashes, sha256(string_agg(h, ',' ORDER BY h)) AS all_sha256 FROM b GROUP BY accession""")
def reservations(t):
    """Sources of documents as protected ones, turns as proposed ones; one names another key and changes nothing."""
    merged, _ = holdout.reserve(*_reservations(t))
    return merged.select("accession", F.size("sha256").cast("long").alias("hashes"), F.sha2(F.array_join("sha256", ","), 256).alias("all_sha256"))


@query("SELECT DISTINCT source AS accession FROM documents")
def dropped_reservations(t):
    """A ledger rewritten without its sources' hashes has dropped all of them."""
    ledger, new = _reservations(t)
    other = new.groupBy("accession").agg(F.collect_set(F.get("sha256", F.lit(0))).alias("sha256"))
    return holdout.dropped_reservations(ledger, other)


@query("""WITH d AS (SELECT source AS split, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, doc_id, lang, n_chars FROM documents), k AS (SELECT *, n_chars % 9 AS m FROM d)
SELECT doc_id::VARCHAR AS id, 'content_changed' AS rule FROM k WHERE m = 1 UNION ALL SELECT doc_id::VARCHAR, 'split_differs' FROM k WHERE m = 2 UNION ALL SELECT doc_id::VARCHAR, 'input_differs' FROM k WHERE m = 3
UNION ALL SELECT doc_id::VARCHAR, 'prompt' FROM k WHERE m = 4 UNION ALL SELECT doc_id::VARCHAR, 'roles' FROM k WHERE m = 5 UNION ALL SELECT doc_id::VARCHAR, 'label' FROM k WHERE m = 6 UNION ALL SELECT split || ':' || position, 'no_example' FROM k WHERE m = 7
UNION ALL SELECT doc_id::VARCHAR, 'not_json' FROM k WHERE m = 8 UNION ALL SELECT 'x' || doc_id, 'no_row' FROM k WHERE m = 7""")
def dataset_audit(t):
    """Documents as a published dataset whose rows, examples and inputs are spoilt in eight ways."""
    from .scored import filled, label

    m = c("n_chars") % 9
    told = label(ticker=F.when(m == 6, F.lit("{}")).otherwise(filled(c("lang"))))
    said = lambda role, x: F.concat(F.lit('{"role": "'), role, F.lit('", "content": '), text.json_quoted(x), F.lit("}"))
    value = F.concat(F.lit('{"messages": ['), said(F.lit("system"), F.when(m == 4, "another").otherwise("prompt")), F.lit(", "), said(F.when(m == 5, "system").otherwise(F.lit("user")), c("lang")), F.lit(", "), said(F.lit("assistant"), told), F.lit("]}"))
    docs = ordered.positions(t("documents"), ["source"], ["doc_id"]).select("doc_id", c("source").alias("split"), "position", "lang", m.alias("m"), F.when(m == 8, F.concat(value, F.lit(","))).otherwise(value).alias("value"))
    place = F.when(c("m") == 7, c("position") + 1_000_000).otherwise(c("position"))
    examples = docs.select(F.concat(F.when(c("m") == 7, "x").otherwise(""), "doc_id").alias("packet_id"), "split", place.alias("position"), F.when(c("m") == 1, F.lit("z")).otherwise(F.sha2("value", 256)).alias("row_sha256"), F.when(c("m") == 2, "q").otherwise(c("split")).alias("selection_split"))
    inputs = docs.select(c("doc_id").cast("string").alias("packet_id"), F.when(c("m") == 3, "other").otherwise(c("lang")).alias("model_input"))
    return datasets.dataset_problems(docs.select("split", "position", "value"), examples, "prompt", inputs)


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT doc_id::VARCHAR AS packet_id, 'another_version' AS rule FROM d WHERE k = 1 UNION ALL SELECT doc_id::VARCHAR, 'fields' FROM d WHERE k = 2
UNION ALL SELECT doc_id::VARCHAR, 'no_draft' FROM d WHERE k = 3 UNION ALL SELECT 'x' || doc_id, 'unknown_packet' FROM d WHERE k = 4""")
def draft_audit(t):
    k = c("doc_id") % 5
    part = '{"value": "", "raw_text": "", "availability": "PRESENT", "origin": "INFERRED", "evidence_input": "", "note": ""}'
    whole = "{" + ", ".join(f'"{n}": {part}' for n in datasets.CONTRACT) + "}"
    docs = t("documents").select(c("doc_id").cast("string").alias("packet_id"), k.alias("k"), F.md5("text").alias("source_sha256"), F.lit("v").alias("packet_version"), F.md5("lang").alias("packet_fingerprint"), F.lit("b").alias("input_binding"))
    drafts = docs.where("k <> 3").withColumn("packet_version", F.when(c("k") == 1, "w").otherwise("v")).withColumn("fields", F.when(c("k") == 2, F.lit("{}")).otherwise(F.lit(whole)))
    extra = drafts.where("k = 4").withColumn("packet_id", F.concat(F.lit("x"), "packet_id"))
    return datasets.draft_problems(docs, drafts.unionByName(extra))


@query("""SELECT doc_id::VARCHAR AS packet_id, 'view' AS "column" FROM documents WHERE n_chars % 4 = 1 UNION ALL SELECT doc_id::VARCHAR, 'input' FROM documents WHERE n_chars % 4 = 2 UNION ALL SELECT doc_id::VARCHAR, unnest(['view', 'input']) FROM documents WHERE n_chars % 4 = 3""")
def packets_rebuilt(t):
    """Saved packets against rebuilt ones; some differ in a column, some are gone."""
    m = c("n_chars") % 4
    saved = t("documents").select(c("doc_id").cast("string").alias("packet_id"), c("lang").alias("view"), c("source").alias("input"), m.alias("m"))
    rebuilt = saved.where("m <> 3").select("packet_id", F.when(c("m") == 1, "z").otherwise(c("view")).alias("view"), F.when(c("m") == 2, "z").otherwise(c("input")).alias("input"))
    return runs.rebuilt_differences(saved, rebuilt, "packet_id", ["view", "input"])


@query("""SELECT d.source || ':' || doc_id AS packet_id, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) - 1 AS position FROM documents d""")
def accepted_order(t):
    """Documents in the order in which one approval names them: backwards."""
    named = t("documents").select((-c("doc_id")).alias("place"), F.concat_ws(":", "source", "doc_id").alias("packet_id"))
    packs = t("documents").select(F.concat_ws(":", "source", "doc_id").alias("packet_id"), c("lang").alias("split"))
    return datasets.accepted(named, packs).drop("place")


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE p_name || p_partkey END AS path, p_partkey % 10 <> 4 AS complete FROM part), n AS (SELECT lower(path) AS f, count(DISTINCT path) AS n FROM p GROUP BY 1)
SELECT path, 'not_complete' AS rule, count(*) AS times FROM p WHERE NOT complete GROUP BY path UNION ALL SELECT path, 'name_clash', count(*) FROM p JOIN n ON f = lower(path) WHERE n > 1 GROUP BY path
UNION ALL SELECT path, 'other_partition', count(*) FROM p WHERE NOT starts_with(path, left(path, 1)) GROUP BY path""")
def import_checks(t):
    name = F.when(c("p_partkey") % 3 == 0, c("p_name")).when(c("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat("p_name", "p_partkey"))
    found = datasets.complete_imports(t("part").select(name.alias("path"), (c("p_partkey") % 10 != 4).alias("complete"), F.lit("training").alias("split"), F.left(name, F.lit(1)).alias("folder")))
    return found.groupBy("path", "rule").agg(F.count("*").alias("times"))


@query("""SELECT o_orderkey AS packet_id, array_to_string(list_sort(list_distinct([o_custkey::VARCHAR, (o_custkey % 40)::VARCHAR])), ',') AS ciks, o_orderkey % 6 = 0 AND o_custkey <> 7 AS cik_differs FROM orders""")
def candidate_keys(t):
    """Registrants that orders and the inventory's locations of their path name; some differ from their own URL."""
    path = (c("o_custkey") % 40).cast("string")
    selections = t("orders").select(c("o_orderkey").alias("packet_id"), path.alias("source_path"), F.when(c("o_orderkey") % 6 == 0, F.lit("x/data/7/")).otherwise("none").alias("source_url"), F.concat(F.lit("00"), "o_custkey").alias("cik"))
    places = selections.select(c("source_path").alias("path")).distinct()
    inventory = places.select("path", F.array(F.struct(F.lit(None).cast("string").alias("cik"), F.concat(F.lit("/Data/0"), "path", F.lit("/")).alias("sec_url"))).alias("locations"))
    return datasets.candidate_ciks(selections, inventory).select("packet_id", F.array_join("ciks", ",").alias("ciks"), "cik_differs")


# Predicates and texts.


@query("""SELECT p_partkey, p_partkey % 3 = 0 AND length(p_partkey::VARCHAR) <= 6 AS accession, p_partkey % 4 <> 1 AS portable, p_partkey % 5 NOT IN (1, 2) AS relative FROM part""")
def name_forms(t):
    k = c("p_partkey")
    number = F.lpad(k.cast("string"), F.greatest(F.length(k.cast("string")), F.lit(6)), "0")  # a longer number is not cut
    accession = F.when(k % 3 == 0, F.concat(F.lit("0000000001-24-"), number)).otherwise(F.concat(F.lit("1-24-"), number))
    name = F.when(k % 4 == 1, F.lit("con.txt")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".htm")))
    path = F.when(k % 5 == 1, F.lit("/a")).when(k % 5 == 2, F.lit("a/../b")).otherwise("a..b/c")
    return t("part").select("p_partkey", files.accession_ok(accession).alias("accession"), files.portable_name(name).alias("portable"), files.relative_path(path).alias("relative"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'failure_page' WHEN 2 THEN 'cut_short' ELSE 'empty' END AS problem FROM pages""")
def fetch_problems(t):
    k = c("page_id") % 4
    body = F.when(k == 1, F.concat(F.lit("<p>Request Rate Threshold Exceeded"), "html")).when(k == 2, F.concat(F.lit("<SEC-DOCUMENT>"), "html")).when(k == 3, F.lit("")).otherwise(c("html"))
    return t("pages").select("page_id", files.fetch_problem(body.cast("binary")).alias("problem"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_nationkey ELSE c_custkey END::VARCHAR AS cik, c_custkey % 3 = 1 AND c_custkey <> c_nationkey AS differs FROM customer""")
def registrants(t):
    k = c("c_custkey")
    told = F.when(k % 3 != 2, F.concat(F.lit("000"), k))
    url = F.when(k % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("https://x/Data/0"), "c_nationkey", F.lit("/a")))
    key, differs = files.registrant(told, url)
    return t("customer").select("c_custkey", key.alias("cik"), differs.alias("differs"))


@query("""SELECT event_id, printf('%d:%02d:%02d', (event_id * 37) // 3600, (event_id * 37) % 3600 // 60, (event_id * 37) % 60) AS took, CASE WHEN event_id % 97 > 0 THEN printf('%.1f%%', 100.0 * (event_id % 2) / 2) END AS share FROM events""")
def duration_texts(t):
    seconds = (c("event_id") * 37).cast("double")
    return t("events").select("event_id", text.duration(seconds).alias("took"), text.percent((c("event_id") % 2) / 2 * (c("event_id") % 97), (c("event_id") % 97).cast("double")).alias("share"))


@query("SELECT c_custkey, c_name || '!' AS plain FROM customer")
def console_texts(t):
    raw = F.concat(F.lit("\x1b[31m"), "c_name", F.lit("\x1b[0m\x1b]0;title\x07!\x00"))
    return t("customer").select("c_custkey", text.plain_console(raw).alias("plain"))


@query("""SELECT doc_id, right(text, 20) AS tail FROM documents WHERE octet_length(encode(right(text, 20))) = 20 AND octet_length(encode(text)) = length(text)""")
def tail_bytes(t):
    docs = t("documents").where(F.octet_length("text") == F.length("text")).where(F.length("text") >= 20)
    return docs.select("doc_id", text.tail_bytes(c("text"), 20).alias("tail"))


@query("""SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k, event_type AS type, '1' AS version FROM events""")
def merged_maps(t):
    """Maps of two sides; where both have a key the second one's value stays."""
    a = F.map_from_arrays(F.array(F.lit("k"), F.lit("version")), F.array(F.lit("-"), F.lit("1")))
    b = F.map_from_arrays(F.array(F.lit("k"), F.lit("type")), F.array(F.regexp_extract("props", "[0-9]+", 0), c("event_type")))
    m = t("events").select("event_id", text.merged(a, b).alias("m"))
    return m.select("event_id", c("m")["k"].cast("long").alias("k"), c("m")["type"].alias("type"), c("m")["version"].alias("version"))


# Messages and sequences.


@query("""SELECT conv_id, turn, sha256('system:You.|user:' || role || '|assistant:' || text) AS said_sha256, length(text) > 0 AS holds FROM conversations""")
def message_rows(t):
    said = answers.messages(F.lit("You."), c("role"), c("text"))
    turns = t("conversations").select("conv_id", "turn", said.alias("m"))
    told = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return turns.select("conv_id", "turn", F.sha2(told, 256).alias("said_sha256"), answers.roles_hold(c("m")).alias("holds"))


@query("""WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey), e AS (SELECT *, len(list_filter(a, lambda x: x = 3)) = 1 AS one, list_position(a, 3) AS pos FROM o)
SELECT l_orderkey, CASE WHEN one AND pos + 2 <= 6 THEN array_to_string(list_concat([7, 8], a[1:pos]), ',') END AS input_ids, CASE WHEN one AND pos + 2 <= 6 THEN array_to_string(list_concat([-100, -100], a[1:pos]), ',') END AS labels,
  CASE WHEN one AND pos + 2 <= 6 THEN 2 END AS prompt_length, CASE WHEN one AND pos + 2 <= 6 THEN pos END::INT AS answer_length FROM e""")
def training_sequences(t):
    """Line numbers of each order as an answer that ends at its only 3, after a prompt of two tokens."""
    ids = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_linenumber"].cast("int")).alias("a"))
    s = answers.trained(F.array(F.lit(7), F.lit(8)), c("a"), 3, 6)
    told = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    return ids.select("l_orderkey", told(s["input_ids"]).alias("input_ids"), told(s["labels"]).alias("labels"), s["prompt_length"].alias("prompt_length"), s["answer_length"].alias("answer_length"))


@query("""SELECT conv_id, turn, sha256('{"messages":[{"role":"system","content":"You."},{"role":"user","content":"' || role || '"}],"max_tokens":64,"temperature":0,"stream":true,"cache_prompt":false}') AS body_sha256 FROM conversations""")
def request_bodies(t):
    said = F.slice(answers.messages(F.lit("You."), c("role"), F.lit("")), 1, 2)
    return t("conversations").select("conv_id", "turn", F.sha2(answers.request_body(said, 64), 256).alias("body_sha256"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'LENGTH_STOP' WHEN o_orderkey % 3 = 0 THEN 'TERMINATION_MISMATCH' ELSE 'COMPLETE' END AS status,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'SAVED' ELSE 'RUNNING' END AS shown FROM orders""")
def run_statuses(t):
    status = F.when(c("o_orderkey") % 3 == 0, "TERMINATION_MISMATCH").otherwise("COMPLETE")
    shown = runs.run_status(F.lit("RUNNING"), (c("o_orderkey") % 2).cast("int"), F.when(c("o_orderstatus") != "P", "SAVED"))
    return t("orders").select("o_orderkey", runs.stopped_status(status, F.when(c("o_orderstatus") == "F", "limit").otherwise("eos")).alias("status"), shown.alias("shown"))


@query("""SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PENDING_REVIEW' ELSE 'INCOMPLETE' END AS status, CASE WHEN r_regionkey % 3 = 0 THEN r_regionkey::DOUBLE / 12 END AS ratio, CASE r_regionkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS exit_code FROM region""")
def run_summaries(t):
    status = F.when(c("r_regionkey") % 3 == 0, "COMPLETE").when(c("r_regionkey") % 3 == 1, "PENDING_REVIEW").otherwise("INCOMPLETE")
    report = t("region").select("r_regionkey", status.alias("status"), F.lit(12).alias("targets"), c("r_regionkey").alias("format_valid"), c("r_regionkey").alias("correct"))
    found = runs.summary(report)
    return found.select(c("format_valid").alias("r_regionkey"), "status", "ratio", "exit_code")


# Ledgers, events and progress.


@query("""WITH l AS (SELECT user_id::VARCHAR || ':' || (event_id // 100) AS execution_id, event_type = 'view' AS open, value FROM events)
SELECT execution_id, 'started' AS rule, count(*) AS times FROM l WHERE open GROUP BY 1 UNION ALL SELECT execution_id, 'seconds', count(*) FROM l WHERE value - 5 < 0 GROUP BY 1 UNION ALL SELECT execution_id, 'execution_twice', 1 FROM l GROUP BY 1 HAVING count(*) > 1""")
def ledger_audit(t):
    ledger = t("events").select(F.concat_ws(":", "user_id", F.expr("event_id div 100")).alias("execution_id"), F.when(c("event_type") == "view", "STARTED").otherwise("COMPLETE").alias("status"), (c("value") - 5).alias("elapsed_seconds"))
    return files.ledger_problems(ledger).groupBy("execution_id", "rule").agg(F.count("*").alias("times"))


_LINES = "l AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, CASE WHEN event_id % 7 = 0 THEN left(props, 5) ELSE props END AS value FROM events), m AS (SELECT *, json_valid(value) AS ok, max(position) OVER (PARTITION BY path) AS last FROM l)"


def _lines(t) -> DataFrame:
    value = F.when(c("event_id") % 7 == 0, F.left("props", F.lit(5))).otherwise(c("props"))
    return ordered.positions(t("events").select(c("user_id").alias("path"), "event_id", value.alias("value")), ["path"], ["event_id"]).drop("event_id")


@query(f"WITH {_LINES} SELECT path, position, CASE WHEN ok THEN (value ->> '$.k')::BIGINT END AS k, NOT ok AS broken_before_end FROM m WHERE ok OR position < last")
def tolerant_tails(t):
    return files.tolerant_tail(_lines(t), "k long").select("path", "position", c("row.k").alias("k"), "broken_before_end")


@query(f"WITH {_LINES}, b AS (SELECT *, min(position) FILTER (WHERE NOT ok) OVER (PARTITION BY path) AS bad FROM m) SELECT path, position, (value ->> '$.k')::BIGINT AS k FROM b WHERE bad IS NULL OR position < bad")
def read_until_broken(t):
    return files.read_until_broken(_lines(t), "k long").select("path", "position", c("row.k").alias("k"))


@query("""WITH l AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_type, props, octet_length(encode(CASE event_type WHEN 'error' THEN ': ping' ELSE 'data: ' || props END)) AS size FROM events),
d AS (SELECT *, sum(size + 1) OVER w AS bytes, count(*) FILTER (WHERE event_type <> 'error') OVER w AS n FROM l WINDOW w AS (PARTITION BY path ORDER BY position))
SELECT path, position, (props ->> '$.k')::BIGINT AS k, size > 16 OR bytes > 500 OR n > 20 AS too_long FROM d WHERE event_type <> 'error'""")
def server_events(t):
    line = F.when(c("event_type") == "error", ": ping").otherwise(F.concat(F.lit("data: "), "props"))
    lines = ordered.positions(t("events").select(c("user_id").alias("path"), "event_id", line.alias("value")), ["path"], ["event_id"])
    found = files.server_events(lines, "k long", line_limit=16, stream_limit=500, token_limit=20)
    return found.select("path", "position", c("event.k").alias("k"), "too_long")


@query(r"""WITH t AS (SELECT conv_id, string_agg(text || CASE WHEN turn % 2 = 0 THEN chr(13) || chr(10) ELSE '' END, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, string_split(t, chr(10)) AS x FROM t),
k AS (SELECT conv_id, CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM s), f AS (SELECT conv_id, flatten(list_transform(x, lambda l: list_transform(generate_series(0, greatest((length(l) - 1) // 200, 0)), lambda i: rtrim(l[i * 200 + 1:i * 200 + 200], chr(13))))) AS x FROM k)
SELECT conv_id, len(x)::BIGINT AS lines, sha256(array_to_string(x, '|')) AS lines_sha256 FROM f""")
def framed_lines(t):
    """Turns as chunks of a stream, framed into lines of 200 characters at most."""
    chunk = F.concat("text", F.when(c("turn") % 2 == 0, "\r\n").otherwise(""))
    found = files.framed_lines(t("conversations").select(c("conv_id").alias("path"), c("turn").alias("position"), chunk.alias("value")), limit=200)
    rows = found.groupBy(c("path").alias("conv_id")).agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("x"))
    return rows.select("conv_id", "lines", F.sha2(F.array_join(F.transform("x", lambda r: r["value"]), "|"), 256).alias("lines_sha256"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'phase' WHEN 'click' THEN 'update' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN floor(value) END AS seconds FROM events""")
def streamed_events(t):
    """Events as lines of a telemetry stream: kinds that are unknown, negative times and broken lines give nulls."""
    kind = F.when(c("event_type") == "view", "phase").when(c("event_type") == "click", "update").when(c("event_type") == "signup", "guess").otherwise("memory")
    seconds = F.when(c("event_type") == "error", -1.0).otherwise(F.floor("value"))
    line = F.concat(F.lit('{"schema_version": "training-event-v1", "kind": "'), kind, F.lit('", "attempt_elapsed_seconds": '), seconds, F.when(c("event_type") == "purchase", "").otherwise("}"))
    return t("events").select("event_id", event_streams.events(line).alias("e")).select("event_id", "e.kind", "e.seconds")


@query("""SELECT event_id, 'EVENT ' || '{"k": ' || (props ->> '$.k') || ', "type": "' || event_type || '"}' AS line FROM events""")
def event_lines(t):
    event = F.concat(F.lit('{"type":"'), "event_type", F.lit('","k":'), F.regexp_extract("props", "[0-9]+", 0), F.lit("}"))
    return sinks.event_lines(t("events").select("event_id", event.alias("event")), "EVENT ").select("event_id", "line")


@query("""WITH m AS (SELECT event_id, event_id % 100 AS a, event_id % 50 AS r, event_id % 90 AS pa, event_id % 60 AS pr, CASE WHEN event_id % 5 <> 0 THEN 'w' END AS w, CASE WHEN event_id % 6 <> 0 THEN 1 END AS f FROM events)
SELECT event_id, 'peak_allocated' AS rule FROM m WHERE pa < a UNION ALL SELECT event_id, 'peak_reserved' FROM m WHERE pr < r UNION ALL SELECT event_id, 'window' FROM m WHERE w IS NULL UNION ALL SELECT event_id, 'count_free_device_bytes' FROM m WHERE f IS NULL""")
def memory_samples(t):
    k = c("event_id")
    m = t("events").select("event_id", (k % 100).alias("allocated_bytes"), (k % 50).alias("reserved_bytes"), (k % 90).alias("peak_allocated_bytes"), (k % 60).alias("peak_reserved_bytes"), F.when(k % 6 != 0, F.lit(1)).alias("free_device_bytes"), F.when(k % 5 != 0, "w").alias("window_label"))
    return _by_rule(rules.violations(m, "event_id", runs.memory_rules()), "event_id")


@query("""WITH p AS (SELECT event_id, user_id, ts, floor(value)::BIGINT AS done, event_id % 7 AS failed FROM events), q AS (SELECT *, lag(done) OVER w AS d, lag(failed) OVER w AS f FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, 'bounds' AS rule FROM q WHERE NOT (failed >= 0 AND failed <= done AND done <= 60) UNION ALL SELECT event_id, 'monotonic' FROM q WHERE done < d OR failed < f""")
def progress_counts(t):
    p = t("events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("completed"), (c("event_id") % 7).alias("failed"), F.lit(60).alias("total"))
    both = ordered.adjacent(p, ["user_id"], ["ts", "event_id"], ["completed", "failed"]).withColumnsRenamed({"before_completed": "previous_completed", "before_failed": "previous_failed"})
    return _by_rule(rules.violations(both, "event_id", runs.progress_rules()), "event_id")


@query("""SELECT event_id, min(floor(value)) OVER w AS least, max(floor(value)) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_extremes(t):
    e = t("events").select("event_id", "user_id", "ts", F.floor("value").cast("double").alias("v"))
    return ordered.extremes(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "least", "most")


@query("""SELECT event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shown, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events""")
def neighbours(t):
    e = ordered.adjacent(ordered.shown_counters(t("events"), ["user_id"], ["ts", "event_id"], "event_id"), ["user_id"], ["ts", "event_id"], ["event_id"])
    return e.select("event_id", "shown", c("before_event_id").alias("before"), c("after_event_id").alias("after"))


@query("""WITH u AS (SELECT user_id, floor(value)::BIGINT AS s, event_id % 97 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, 'all' AS period, count(*) AS updates, max(n * 100)::BIGINT AS s, sum(n)::BIGINT AS n FROM u GROUP BY 1 UNION ALL SELECT user_id, 'first', 1, s, n FROM u WHERE i = 1
UNION ALL SELECT user_id, 'later', count(*) - 1, coalesce(sum(s) FILTER (WHERE i > 1), 0)::BIGINT, coalesce(sum(n) FILTER (WHERE i > 1), 0)::BIGINT FROM u GROUP BY 1""")
def attempt_totals(t):
    u = t("events").select("user_id", "ts", "event_id", F.floor("value").cast("long").alias("s"), (c("event_id") % 97).alias("n"), ((c("event_id") % 97) * 100).alias("clock"))
    return ordered.attempt_totals(u, ["user_id"], ["ts", "event_id"], ["s", "n"], "clock")


@query("""SELECT event_id, CASE WHEN value > 60 THEN 'STALE_SAMPLES' WHEN value < 2 THEN 'HOST_MEMORY_LIMIT' WHEN event_id % 50 >= 40 THEN 'PHASE_TIMEOUT' WHEN event_id % 90 >= 80 THEN 'AGGREGATE_TIMEOUT' END AS reason FROM events""")
def stop_reasons(t):
    low = F.when(c("value") < 2, 2).otherwise(0)
    return t("events").select("event_id", runs.stop_reason(c("value"), low, c("event_id") % 50, c("event_id") % 90, stale=60, samples=2, phase_limit=40, total_limit=80).alias("reason"))


@query("""SELECT event_type, count(*) FILTER (WHERE event_type NOT IN ('view', 'click') OR value < 5) AS failed FROM events GROUP BY event_type""")
def generation_failures(t):
    status = F.when(c("value") < 5, "FAILED").when(c("event_type") == "view", "COMPLETE").when(c("event_type") == "click", "LENGTH_STOP")
    return t("events").groupBy("event_type").agg(answers.failures(status).alias("failed"))


@query("""WITH s AS (SELECT conv_id, conv_id % 5 AS k FROM conversations GROUP BY conv_id) SELECT conv_id, 'another_set' AS rule FROM s WHERE k = 1 UNION ALL SELECT conv_id, 'session_time' FROM s WHERE k = 2
UNION ALL SELECT DISTINCT conv_id, 'unknown_packet' FROM conversations WHERE role = 'system' UNION ALL SELECT DISTINCT conv_id, 'binding_changed' FROM conversations WHERE turn = 3
UNION ALL SELECT DISTINCT conv_id, 'reviewed_but_open' FROM conversations WHERE role = 'user' AND (turn % 4 = 2 OR length(text) % 3 = 0)""")
def review_drafts(t):
    """Conversations as saved review sessions, turns as their packets; those of users are marked reviewed."""
    turns = t("conversations").select(c("conv_id").alias("session_id"), c("turn").alias("packet_id"), "role", F.length("text").alias("n"))
    k = c("session_id") % 5
    drafts = turns.select("session_id").distinct().select("session_id", F.when(k == 1, "b").otherwise("a").alias("set_id"), F.lit("a").alias("own_set"), F.lit("s").alias("schema"), F.lit("s").alias("own_schema"), F.when(k == 2, 1801).otherwise(1800).alias("active_seconds"), F.lit(240).alias("prior_minutes"))
    packs = turns.select("session_id", "packet_id", (c("role") != "system").alias("known"), F.lit("b").alias("input_binding"), F.when(c("packet_id") == 3, "z").otherwise("b").alias("own_binding"), (c("role") == "user").alias("reviewed"))
    fields = turns.select("session_id", "packet_id", F.when(c("packet_id") % 4 == 2, "").otherwise("PRESENT").alias("availability"))
    corrections = turns.select("session_id", "packet_id", F.when(c("n") % 3 == 0, " ").otherwise("r").alias("reason"))
    return runs.review_draft_problems(drafts, packs, fields, corrections).select(c("session_id").alias("conv_id"), "rule")


@query("""SELECT conv_id, turn, CASE WHEN length(role) > 4 THEN sha256(text) ELSE role END AS value, nullif(CASE WHEN length(role) > 4 THEN '' ELSE role END, '-') AS before FROM conversations""")
def revealed_drafts(t):
    turns = t("conversations").select("conv_id", "turn", F.when(F.length("role") > 4, "").otherwise(c("role")).alias("value"))
    drafts = t("conversations").select("conv_id", "turn", F.sha2("text", 256).alias("value"))
    return runs.revealed(turns, drafts, ["conv_id", "turn"])


@query("""SELECT doc_id, CASE WHEN n_chars % 3 > 0 THEN sha256(text) END AS content_sha256 FROM documents""")
def retained_documents(t):
    """Selections with the content that manifests embed, by path and hash; some have another hash."""
    docs = t("documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("source_path"), F.sha2("text", 256).alias("h"), "text", "n_chars")
    selections = docs.select("doc_id", "source_path", F.when(c("n_chars") % 3 > 0, c("h")).otherwise("z").alias("source_sha256"))
    held = docs.select("source_path", c("h").alias("source_sha256"), c("text").cast("binary").alias("content"))
    return runs.retained(selections, held).select("doc_id", F.sha2("content", 256).alias("content_sha256"))


# Sources and sinks: written into the shared folder and read again.


def _turn_lines(t) -> DataFrame:
    row = F.concat(F.lit('{"id": '), "conv_id", F.lit(', "turn": '), "turn", F.lit(', "text": '), text.json_quoted(c("text")), F.when(c("turn") == 1, ",").otherwise("}"))
    return ordered.positions(t("conversations").select(c("role").alias("split"), "conv_id", "turn", row.alias("row")), ["split"], ["conv_id", "turn"])


_ROWS = """r AS (SELECT role AS split, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS position, conv_id, turn,
  '{"id": ' || conv_id || ', "turn": ' || turn || ', "text": ' || to_json(text)::VARCHAR || CASE WHEN turn = 1 THEN ',' ELSE '}' END AS value FROM conversations)"""


@query(f"WITH {_ROWS} SELECT split, position, sha256(value) AS value_sha256, turn <> 1 AS ok FROM r")
def published_lines(t):
    """Turns published as JSON lines by role, then read back in order and strictly parsed."""
    lines = _turn_lines(t)
    at = shared(lines.sparkSession, "published")
    sinks.publish(lines, at)
    found = sinks.published(lines.sparkSession, at, "split", "position", "value").withColumn("p", canonical.parsed(c("value"), "row"))
    return found.select("split", "position", F.sha2("value", 256).alias("value_sha256"), c("p.ok").alias("ok"))


@query(f"WITH {_ROWS} SELECT split, count(*) AS rows, 'test-dataset-v1' AS schema, sha256('who and when') AS approval_sha256, 'how' AS preparation FROM r GROUP BY split")
def published_test(t):
    """Turns published as a test dataset with the texts that it rests on; what its manifest then says."""
    lines = _turn_lines(t)
    spark = lines.sparkSession
    at = shared(spark, "test")
    datasets.publish_test(lines, at, lines.where("position < 0").select(c("split").alias("id"), c("row").alias("rule")), {"approval": "who and when", "preparation": "how"})
    told = spark.read.text(f"{at}/manifest.json", wholetext=True)
    kind = "schema string, files map<string,struct<rows:bigint>>, acceptance map<string,struct<content:string,sha256:string>>"
    m = told.select(F.from_json("value", kind).alias("m")).select("m.*")
    return m.select(F.explode("files").alias("split", "f"), "schema", c("acceptance")["approval"]["sha256"].alias("approval_sha256"), c("acceptance")["preparation"]["content"].alias("preparation")).select("split", c("f.rows").alias("rows"), "schema", "approval_sha256", "preparation")


@query(f"WITH {_ROWS} SELECT count(*) AS lines, sum(octet_length(encode(value)) + 1)::BIGINT AS bytes, 3::BIGINT AS folders, count(*) FILTER (WHERE turn = 1) AS broken, 0::BIGINT AS wrong_hashes FROM r")
def file_audit(t):
    """Published files by their bytes, against a manifest made of their own hashes and line counts."""
    lines = _turn_lines(t)
    spark, at = lines.sparkSession, shared(lines.sparkSession, "audited")
    sinks.publish(lines, at)
    read = files.json_lines(spark, f"{at}/split=*")
    have = files.inventory(spark, at).where(c("path").rlike("/part-[^/]*$"))
    plain = lambda x: F.regexp_replace(x, "^file:/+", "/")
    read, have = read.withColumn("path", plain("path")), have.withColumn("path", plain("path"))
    manifest = have.select("path", "sha256").join(read.groupBy("path").agg(F.count("*").alias("rows")), "path")
    wrong = files.manifest_problems(read, have, manifest).where("rule <> 'not_json'").agg(F.count("*").alias("wrong_hashes"))
    folders = have.agg(F.sum("bytes").alias("bytes"), F.count_distinct(F.regexp_extract("path", "/(split=[^/]*)/", 1)).alias("folders"))
    return read.agg(F.count("*").alias("lines"), F.count_if(~c("ok")).alias("broken")).join(folders).join(wrong).select("lines", "bytes", "folders", "broken", "wrong_hashes")


@query("SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS position, event_id FROM events")
def ordered_answers(t):
    """Events written as lines in order, read again in the order of the files."""
    rows = t("events").select("event_id", (c("user_id") * 100_000_000 + c("event_id")).alias("place"), c("event_id").cast("string").alias("line"))
    spark = rows.sparkSession
    at = shared(spark, "answers")
    sinks.ordered_lines(rows, at, "place", "line")
    lines = files.numbered_lines(spark, at)
    files_of = lines.groupBy("path").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))  # a row for each file, scanned in parts if they are many
    counts = running(files_of, ["all"], ["path"], {"before": Fold("sum", c("n"), before=True)}).select("path", F.coalesce("before", F.lit(0)).alias("before"))
    return lines.join(counts, "path").select((c("before") + c("position")).alias("position"), c("value").cast("long").alias("event_id"))


@query("SELECT event_type, count(*) AS n, (count(*) FILTER (WHERE event_type = 'view')) > 0 AS open FROM events GROUP BY event_type UNION ALL SELECT 'later', count(*), false FROM region")
def appended_ledger(t):
    """Events appended to a ledger, then regions, and all read again."""
    e = t("events").select(c("event_type").alias("execution_id"), F.when(c("event_type") == "view", "STARTED").otherwise("COMPLETE").alias("status"), F.lit(1.0).alias("elapsed_seconds"))
    spark = e.sparkSession
    at = shared(spark, "ledger")
    sinks.append_ledger(e, at)
    sinks.append_ledger(t("region").select(F.lit("later").alias("execution_id"), F.lit("COMPLETE").alias("status"), F.lit(2.0).alias("elapsed_seconds")), at)
    ledger = sinks.read_ledger(spark, at, "execution_id string, status string, elapsed_seconds double")
    return ledger.groupBy(c("execution_id").alias("event_type")).agg(F.count("*").alias("n"), (F.count_if(c("status") == "STARTED") > 0).alias("open"))


@query(f"""WITH {_CUT}, k AS (SELECT * FROM cut WHERE pos > 0) SELECT doc_id::VARCHAR AS packet_id, sha256('["a","' || sha256(text) || '",[0,' || pos || ']]') AS target_id,
  sha256('BEGIN MARKED TARGET' || chr(10) || 'B1 source bytes 0:' || pos || chr(10) || to_json(string_split(text, chr(10))[1])::VARCHAR || chr(10) || 'END MARKED TARGET' || chr(10) || '[OMITTED SOURCE BYTES ' || pos || ':' || size || ']') AS input_sha256 FROM k""")
def prepared_packets(t):
    """The chain of preparation over the first lines of documents: rules, packets, publication, and the set read again."""
    p = _packets_of_first_lines(t).withColumn("sha256", F.sha2("content", 256))
    selections = p.select("packet_id", F.lit("a").alias("accession"), c("packet_id").alias("source_path"), c("sha256").alias("source_sha256"), "encoding", F.lit("training").alias("split"), F.lit("g").alias("group_id"), F.lit(None).cast("string").alias("family_id"),
                          "spans", "target", F.lit("yes").alias("boundary_review"), F.lit("me").alias("reviewer"), F.array().cast("array<string>").alias("ciks"))
    spark = p.sparkSession
    sources = p.select(c("packet_id").alias("path"), "content", "sha256", "length")
    assignments = spark.createDataFrame([("a", "training", "g")], "accession string, split string, group_id string")
    ledger = spark.createDataFrame([], "accession string, aliases array<string>, group_id string, family_id string, cik string, sha256 array<string>")
    made, problems = datasets.prepared(selections, sources, assignments, ledger)
    at = shared(spark, "packets")
    # Texts that documents repeat make equal targets of one source; those are no fault of this chain.
    datasets.publish_packets(made, "prompt", at, problems.where("rule <> 'target_overlaps'"))
    found = spark.read.schema("packet_id string, target_id string, model_input string").json(f"{at}/rows")
    return found.select("packet_id", "target_id", F.sha2("model_input", 256).alias("input_sha256"))


@query("""WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents)
SELECT doc_id::VARCHAR AS packet_id, lang AS split, position, '-' AS rule FROM d WHERE lang <> 'fr' UNION ALL SELECT doc_id::VARCHAR, '-', 0, 'unsupported_quotation' FROM d WHERE lang = 'es' UNION ALL SELECT '1', '-', 0, 'not_reviewed' FROM d GROUP BY ALL HAVING bool_or(lang = 'de')""")
def accepted_dataset(t):
    """The chain of acceptance over documents that are not French: rows with their places, and what forbids them."""
    from .scored import filled, label

    docs = t("documents").select(c("doc_id").cast("string").alias("packet_id"), "doc_id", c("lang").alias("split"), c("source").alias("model_input"), F.array(F.when(c("lang") == "es", F.lit("none")).otherwise(c("source"))).alias("cells"), F.lit("b").alias("rebuilt_binding"), "source", "lang")
    review = docs.select("packet_id", (c("lang") != "de").alias("reviewed"), F.lit("b").alias("input_binding"), label(issuer_name=filled(c("source"), c("source"))).alias("label"))
    named = docs.where("lang <> 'fr'").select(F.lit(1).alias("approval_id"), c("doc_id").alias("place"), "packet_id")
    approvals = t("documents").sparkSession.createDataFrame([(1, "ACCEPTED", "h", "h", "me", "2024-01-01")], "approval_id int, decision string, export_sha256 string, review_sha256 string, reviewer string, accepted_at string")
    rows, problems = datasets.accepted_rows(docs.drop("source", "lang", "doc_id"), review, approvals, named, "prompt")
    told = problems.select(c("id").alias("packet_id"), F.lit("-").alias("split"), F.lit(0).cast("long").alias("position"), "rule")
    return rows.select("packet_id", "split", "position", F.lit("-").alias("rule")).unionByName(told)


@query("""SELECT 'prior-' || r_name || '.json' AS path, sha256('{"region": "' || r_name || '"}') AS sha256 FROM region""")
def baseline_snapshot(t):
    """A baseline kept once; keeping it again is refused."""
    names = [r["r_name"] for r in t("region").orderBy("r_regionkey").collect()]  # the five regions
    spark = t("region").sparkSession
    at = shared(spark, "baseline")
    texts = {f"prior-{n}.json": f'{{"region": "{n}"}}' for n in names}
    bound = sinks.snapshot(spark, texts, at)
    try:
        sinks.snapshot(spark, texts, at)
    except sinks.Exists:
        return spark.createDataFrame(bound, "path string, sha256 string")
    raise AssertionError("a baseline was replaced")
