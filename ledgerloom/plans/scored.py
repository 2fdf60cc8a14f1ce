"""Labels, answers and their scores over the driver tables, with their SQL.

Labels are spelled from columns: a field that a query names is filled, the others are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_quoted
from ..operators import joins, labels, runs, scoring
from ..operators.labels import CONTRACT
from .audit import query

ABSENT = '{"value": null, "raw_text": null, "availability": "ABSENT_IN_CONTEXT", "origin": null}'


def filled(value: Column, raw: Column | None = None, origin: str = "EXTRACTED") -> Column:
    """The JSON of a field that is present."""
    told = F.lit("null") if raw is None else F.coalesce(json_quoted(raw), F.lit("null"))
    return F.concat(F.lit('{"value": '), json_quoted(value), F.lit(', "raw_text": '), told, F.lit(f', "availability": "PRESENT", "origin": "{origin}"}}'))


def label(**fields: Column) -> Column:
    """The JSON of a label."""
    parts = [F.lit('{"fields": {')]
    for i, name in enumerate(CONTRACT):
        parts += [F.lit(f'{", " if i else ""}"{name}": '), fields.get(name, F.lit(ABSENT))]
    return F.concat(*parts, F.lit("}}"))


def _labelled(t) -> DataFrame:
    marks = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return t("documents").select("doc_id", "source", "lang", "n_chars").join(marks, "doc_id", "left")


_LABELLED = """m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT d.doc_id, source, lang, n_chars, quality, toxic FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id)"""


def _cases(docs: DataFrame) -> DataFrame:
    reference = label(ticker=filled(F.col("lang")), issuer_name=filled(F.col("source"), F.col("source")))
    odd = F.when(F.col("doc_id") % 11 == 0, F.lit("{}")).otherwise(reference)
    return docs.select(F.col("doc_id").alias("id"), odd.alias("reference"), reference.alias("whole"), F.array(F.when(F.col("toxic") == 1, F.lit("none")).otherwise(F.col("source"))).alias("cells"))


def _answers(docs: DataFrame) -> DataFrame:
    """The ticker is right for documents of quality 1; the issuer differs in case and space alone."""
    said = label(ticker=filled(F.when(F.col("quality") == 1, F.col("lang")).otherwise("zz")), issuer_name=filled(F.concat(F.lit(" "), F.upper("source")), F.col("source"), "DERIVED"))
    return docs.where("quality is not null").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 200, "TIMEOUT").otherwise("COMPLETE").alias("status"), said.alias("text"))


def _decisions(docs: DataFrame) -> DataFrame:
    return docs.where("toxic = 0").select(F.col("doc_id").alias("id"), F.lit(False).alias("same_subject"))


@query(f"""WITH {_LABELLED}, v AS (SELECT *, n_chars >= 200 AS valid FROM j WHERE quality IS NOT NULL)
SELECT count(*) AS targets, 'COMPLETE' AS status, count(*) FILTER (WHERE valid) AS format_valid, 0::BIGINT AS exact, count(*) FILTER (WHERE valid AND quality = 1) AS correct, count(*) FILTER (WHERE valid AND quality = 1) AS field_ticker,
  count(*) FILTER (WHERE valid) AS field_issuer_name, count(*) FILTER (WHERE valid) AS origin_errors, 0::BIGINT AS derivation_errors, count(*) FILTER (WHERE valid AND toxic = 1) AS unsupported_quotes FROM v""")
def scoring_report(t):
    """All labelled documents as cases, all answered and decided."""
    docs = _labelled(t).where("quality is not null")
    decided = docs.select(F.col("doc_id").alias("id"), F.lit(False).alias("same_subject"))
    _, report, _ = scoring.evaluate(_cases(docs).withColumn("reference", F.col("whole")), _answers(docs), decided)
    return report.select("targets", "status", "format_valid", "exact", "correct", "field_ticker", "field_issuer_name", "origin_errors", "derivation_errors", "unsupported_quotes")


_STATES = f"""WITH {_LABELLED}, s AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'INVALID' WHEN quality IS NULL THEN 'MISSING' WHEN n_chars >= 200 AND coalesce(toxic, 1) <> 0 THEN 'PENDING' ELSE 'SCORED' END AS state FROM j)"""


@query(f"{_STATES} SELECT doc_id AS id, state FROM s")
def case_states(t):
    docs = _labelled(t)
    return scoring.case_states(_cases(docs), _answers(docs), _decisions(docs)).select("id", "state")


@query(f"{_STATES} SELECT doc_id AS id FROM s WHERE state = 'PENDING'")
def pending_reviews(t):
    docs = _labelled(t)
    return scoring.evaluate(_cases(docs), _answers(docs), _decisions(docs))[2]


@query(f"""{_STATES} SELECT source, quality, count(*) AS targets, CASE WHEN bool_or(state = 'INVALID') THEN 'INVALID_REFERENCES' WHEN bool_or(state = 'MISSING') THEN 'INCOMPLETE'
  WHEN bool_or(state = 'PENDING') THEN 'PENDING_REVIEW' ELSE 'COMPLETE' END AS status FROM s GROUP BY source, quality""")
def status_precedence(t):
    """The status of every source's cases, by quality: the gravest of their states."""
    docs = _labelled(t)
    states = scoring.case_states(_cases(docs), _answers(docs), _decisions(docs)).join(docs.select(F.col("doc_id").alias("id"), "source", "quality"), "id")
    any_ = lambda s: F.coalesce(F.bool_or(F.col("state") == s), F.lit(False))
    return states.groupBy("source", "quality").agg(F.count("*").alias("targets"), scoring.overall(any_("INVALID"), any_("MISSING"), any_("PENDING")).alias("status"))


@query(f"""{_STATES}, k AS (SELECT *, n_chars >= 200 AS valid FROM s WHERE state = 'SCORED')
SELECT unnest(['{"', '".join(CONTRACT)}']) AS field, count(*) AS n_cases, unnest([{", ".join("count(*) FILTER (WHERE valid AND quality = 1)" if f == "ticker" else "count(*) FILTER (WHERE valid)" for f in CONTRACT)}]) AS n_correct FROM k""")
def field_unpivot_accuracy(t):
    docs = _labelled(t)
    return scoring.field_accuracy(scoring.case_states(_cases(docs), _answers(docs), _decisions(docs)))


@query(f"""{_STATES}, v AS (SELECT * FROM s WHERE state = 'SCORED' AND n_chars >= 200)
SELECT doc_id AS id, 1::BIGINT AS origin_errors, CASE WHEN quality = 1 THEN 0 ELSE 1 END::BIGINT AS primary_errors, (toxic = 1)::BIGINT AS unsupported_quotes FROM v""")
def diagnostic_lengths(t):
    """Lengths of the lists of errors of valid, scored answers."""
    docs = _labelled(t)
    states = scoring.case_states(_cases(docs), _answers(docs), _decisions(docs)).where("state = 'SCORED' and score.format_valid")
    return states.select("id", *[F.size(f"score.{c}").cast("long").alias(c) for c in ("origin_errors", "primary_errors", "unsupported_quotes")])


_ODD = """CASE doc_id % 8 WHEN 0 THEN '{"a": 1, "a": 2}' WHEN 1 THEN '{"value": 5, "raw_text": null, "availability": "PRESENT", "origin": "EXTRACTED"}'
 WHEN 2 THEN '{"value": "x", "raw_text": null, "availability": "MAYBE", "origin": "EXTRACTED"}' WHEN 3 THEN '{"value": "x", "raw_text": null, "availability": "PRESENT", "origin": null}'
 WHEN 4 THEN '{"value": "x", "raw_text": null, "availability": "AMBIGUOUS", "origin": null}' WHEN 5 THEN '{"value": "x", "raw_text": 3, "availability": "PRESENT", "origin": "EXTRACTED"}'
 WHEN 6 THEN '{"value": "OTHER", "raw_text": "", "availability": "PRESENT", "origin": "EXTRACTED"}' ELSE '{"value": "x", "availability": "PRESENT", "origin": "EXTRACTED"}' END"""


@query("""SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'label' ELSE 'ticker' END AS path,
  CASE doc_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'not_text' WHEN 2 THEN 'unknown_availability' WHEN 3 THEN 'no_origin' WHEN 4 THEN 'unresolved_but_filled' WHEN 5 THEN 'wording_not_text' WHEN 6 THEN 'other_without_wording' ELSE 'keys' END AS rule FROM documents
UNION ALL SELECT doc_id, 'meeting_date', 'not_a_calendar_date' FROM documents WHERE doc_id % 8 <> 0 AND lang = 'de'
UNION ALL SELECT doc_id, 'vote_components', 'votes_and_participation_differ' FROM documents WHERE doc_id % 8 <> 0 AND lang = 'fr'
UNION ALL SELECT doc_id, 'management_recommendation', 'unknown_value' FROM documents WHERE doc_id % 8 <> 0 AND lang = 'es'""")
def label_faults(t):
    """Labels spoilt in a way that each document's number and language choose, and all that is wrong with them."""
    lang = F.col("lang")
    told = label(
        ticker=F.expr(_ODD), meeting_date=F.when(lang == "de", filled(F.lit("2023-02-29"))).otherwise(filled(F.lit("2024-02-29"))),
        participation=F.when(lang == "fr", filled(F.lit("DID_NOT_VOTE"))).otherwise(filled(F.lit("VOTED"))), management_recommendation=F.when(lang == "es", filled(F.lit("PERHAPS"))).otherwise(filled(F.lit("FOR"))),
    )
    return t("documents").select("doc_id", F.explode(labels.label_problems(told)).alias("p")).select("doc_id", "p.path", "p.rule")


def _quoted(t) -> DataFrame:
    member = F.concat(F.lit('{"value": {"name": '), filled(F.col("lang"), F.col("lang")), F.lit(', "scope_type": '), filled(F.lit("FUND_GROUP")), F.lit(', "members": {"value": ['), filled(F.col("source"), F.col("source")), F.lit(", "),
                      filled(F.lit("x"), F.lit("")), F.lit('], "raw_text": null, "availability": "PRESENT", "origin": "EXTRACTED"}}, "raw_text": null, "availability": "PRESENT", "origin": "DERIVED"}'))
    return t("documents").select("doc_id", "lang", "source", label(reporting_scope=member, issuer_name=filled(F.col("source"), F.concat(F.lit('"'), "source", F.lit('"')))).alias("label"))


@query("""SELECT doc_id, 'reporting_scope.value.name' AS path, lang AS quote FROM documents UNION ALL SELECT doc_id, 'reporting_scope.value.members.value[0]', source FROM documents UNION ALL SELECT doc_id, 'issuer_name', '"' || source || '"' FROM documents""")
def label_quotations(t):
    return labels.quotations(_quoted(t), "doc_id", "label")


@query("""SELECT doc_id, 'fields.reporting_scope.value.members.value[0].value' AS path, to_json(source)::VARCHAR AS node FROM documents UNION ALL SELECT doc_id, 'fields.reporting_scope.value.members.value[7]', NULL FROM documents
UNION ALL SELECT doc_id, 'fields.ticker.availability', '"ABSENT_IN_CONTEXT"' FROM documents UNION ALL SELECT doc_id, 'reporting_scope', NULL FROM documents""")
def label_paths(t):
    paths = F.array(*map(F.lit, ("fields.reporting_scope.value.members.value[0].value", "fields.reporting_scope.value.members.value[7]", "fields.ticker.availability", "reporting_scope")))
    return _quoted(t).withColumn("path", F.explode(paths)).select("doc_id", "path", F.to_json(labels.field_at(F.col("label"), F.col("path"))).alias("node"))


@query(f"""WITH n AS (SELECT unnest(['{"', '".join(CONTRACT)}']) AS field)
SELECT doc_id, field, CASE field WHEN 'ticker' THEN to_json(lang)::VARCHAR WHEN 'issuer_name' THEN to_json(source)::VARCHAR ELSE 'null' END AS value, CASE WHEN field = 'issuer_name' THEN to_json(source)::VARCHAR ELSE 'null' END AS raw_text,
  CASE WHEN field IN ('ticker', 'issuer_name') THEN 'PRESENT' ELSE 'ABSENT_IN_CONTEXT' END AS availability, CASE WHEN field IN ('ticker', 'issuer_name') THEN 'EXTRACTED' ELSE '' END AS origin FROM documents, n""")
def review_texts(t):
    told = label(ticker=filled(F.col("lang")), issuer_name=filled(F.col("source"), F.col("source")))
    return labels.review_fields(t("documents").select("doc_id", told.alias("label")), "doc_id", "label").select("doc_id", "field", "value", "raw_text", "availability", "origin")


def _cells(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.slice(F.split("text", "\n"), 1, 3)).alias("cell_index", "text")).withColumn("block_index", F.lit(0))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:3]) AS cell, generate_subscripts(string_split(text, chr(10))[1:3], 1) - 1 AS i, source, lang FROM documents),
d AS (SELECT d.doc_id, d.doc_id % 3 AS cell_index, d.doc_id % 5 AS k, left(text, 12) AS passage, cell FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = d.doc_id % 3)
SELECT doc_id::VARCHAR AS id, 'binding' AS rule FROM d WHERE k = 1 UNION ALL SELECT doc_id::VARCHAR, 'quotes' FROM d WHERE k = 2 UNION ALL SELECT doc_id::VARCHAR, 'evidence' FROM d WHERE k <> 3 AND NOT coalesce(contains(cell, passage) AND length(passage) > 0, false)
UNION ALL SELECT doc_id::VARCHAR, 'reviewed' FROM d WHERE k = 4 UNION ALL SELECT doc_id::VARCHAR, 'reason' FROM d WHERE k = 2""")
def review_decisions(t):
    """Decisions over all documents that name a line as cell; some are bound to another answer, quote a path that is not there, or are not made."""
    k = F.col("id") % 5
    d = t("documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(12)).alias("passage"))
    decisions = d.select(
        "id", F.when(k == 1, "other").otherwise("b").alias("binding"), (k != 4).alias("reviewed"), (k != 3).alias("subject_equivalent"), F.lit(0).alias("block_index"), (F.col("id") % 3).cast("int").alias("cell_index"), "passage",
        F.when(k == 2, " ").otherwise("r").alias("reason"), F.when(k == 2, F.array(F.lit("ticker"))).otherwise(F.array(F.lit("issuer_name"))).alias("quotation_errors"),
    )
    quotes = labels.quotations(_quoted(t).withColumnRenamed("doc_id", "id"), "id", "label")
    return runs.decision_problems(decisions, d.select("id", F.lit("b").alias("answer_binding")), _cells(t), quotes)


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS k, contains(string_split(text, chr(10))[1], left(text, 5)) AND length(text) > 0 AS held FROM documents)
SELECT doc_id::VARCHAR AS id, 'binding' AS rule FROM d WHERE k = 1 UNION ALL SELECT doc_id::VARCHAR, 'field' FROM d WHERE k = 2 UNION ALL SELECT doc_id::VARCHAR, 'passage' FROM d WHERE NOT held
UNION ALL SELECT doc_id::VARCHAR, 'category' FROM d WHERE k = 2 OR k = 3 OR NOT held""")
def wording_equivalences(t):
    """Decisions that two wordings of OTHER mean the same, over all documents; some name another answer, field or category."""
    k = F.col("id") % 4
    other = lambda v: label(participation=filled(v, F.col("w")))
    docs = t("documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(5)).alias("w"))
    cases = docs.select("id", other(F.lit("OTHER")).alias("reference"), other(F.when(k == 3, "VOTED").otherwise("OTHER")).alias("answer"), F.lit("r").alias("reference_binding"), F.lit("a").alias("answer_binding"))
    at = "fields.participation"
    decisions = docs.select(
        "id", F.lit(at).alias("reference_field_path"), F.when(k == 2, "fields.ticker").otherwise(at).alias("prediction_field_path"), F.lit(0).alias("block_index"), F.lit(0).alias("cell_index"), F.lit("c").alias("column"),
        F.col("w").alias("passage"), F.lit("why").alias("reason"), F.lit("r").alias("reference_sha256"), F.when(k == 1, "z").otherwise("a").alias("answer_sha256"),
    )
    return scoring.equivalence_problems(decisions, cases, _cells(t))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS k, coalesce(length(text), 0) > 0 AS told, contains(string_split(text, chr(10))[1], left(text, 5)) AS held,
  trim(regexp_replace(left(text, 5), '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g')) = trim(regexp_replace(left(text, 4), '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g')) AS alike FROM documents)
SELECT doc_id AS id, CASE WHEN told THEN 'SCORED' ELSE 'INVALID' END AS state, CASE WHEN told THEN k <> 3 AND (alike OR (k = 0 AND held)) END AS correct FROM d""")
def equivalence_scores(t):
    """Cases of OTHER whose answer words it otherwise, evaluated with the reviewers' sound decisions; three of four documents have none that holds."""
    k = F.col("id") % 4
    docs = t("documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(5)).alias("w"), F.left("text", F.lit(4)).alias("v"))
    voted = lambda value, raw: label(participation=filled(value, F.col(raw)))
    cases = docs.select("id", voted(F.lit("OTHER"), "w").alias("reference"), voted(F.when(k == 3, "VOTED").otherwise("OTHER"), "v").alias("answer"), F.lit("r").alias("reference_binding"), F.lit("a").alias("answer_binding"))
    at = "fields.participation"
    decisions = docs.select(
        "id", F.lit(at).alias("reference_field_path"), F.when(k == 2, "fields.ticker").otherwise(at).alias("prediction_field_path"), F.lit(0).alias("block_index"), F.lit(0).alias("cell_index"), F.lit("c").alias("column"),
        F.col("w").alias("passage"), F.lit("why").alias("reason"), F.lit("r").alias("reference_sha256"), F.when(k == 1, "z").otherwise("a").alias("answer_sha256"),
    )
    swaps = scoring.accepted_swaps(decisions, cases, _cells(t))
    answers = cases.select("id", F.lit("COMPLETE").alias("status"), F.col("answer").alias("text"))
    decided = docs.select("id", F.lit(False).alias("same_subject"))
    states, _, _ = scoring.evaluate(cases.select("id", "reference", F.array(F.lit("")).alias("cells")), answers, decided, swaps=swaps)
    return states.select("id", "state", F.col("score.correct").alias("correct"))


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS k, to_json(lang)::VARCHAR AS l, to_json(source)::VARCHAR AS s FROM documents)
SELECT doc_id, 'label' AS path, sha256('{"fields": {' || array_to_string(list_transform(['@@'], lambda n: '"' || n || '": ' || CASE n WHEN 'ticker' THEN '{"value": ' || l || ', "raw_text": null, "availability": "PRESENT", "origin": "EXTRACTED"}'
  WHEN 'issuer_name' THEN '{"value": ' || s || ', "raw_text": ' || s || ', "availability": "PRESENT", "origin": "EXTRACTED"}' ELSE '{"value": null, "raw_text": null, "availability": "ABSENT_IN_CONTEXT", "origin": null}' END), ', ') || '}}') AS rule FROM d WHERE k IN (0, 4)
UNION ALL SELECT doc_id, 'ticker', 'json' FROM d WHERE k = 1 UNION ALL SELECT doc_id, 'fields', 'keys' FROM d WHERE k = 2 UNION ALL SELECT doc_id, 'ticker', 'unknown_availability' FROM d WHERE k = 3""".replace("@@", "', '".join(CONTRACT)))
def review_labels(t):
    """Labels as edited texts, some spoilt, spelled again: the label's hash, or what is wrong."""
    k = F.col("doc_id") % 5
    told = label(ticker=filled(F.col("lang")), issuer_name=filled(F.col("source"), F.col("source")))
    fields = labels.review_fields(t("documents").select("doc_id", told.alias("label")), "doc_id", "label")
    ticker = F.col("field") == "ticker"
    spoilt = fields.where(~(ticker & (k == 2))).withColumn("value", F.when(ticker & (k == 1), '"').otherwise(F.col("value"))).withColumn("availability", F.when(ticker & (k == 3), "MAYBE").otherwise(F.col("availability")))
    found = labels.review_results(spoilt, "doc_id")
    sound = F.struct(F.lit("label").alias("path"), F.sha2("label", 256).alias("rule"))
    return found.select("doc_id", F.explode(F.when(F.col("label").isNotNull(), F.array(sound)).otherwise(F.col("faults"))).alias("p")).select("doc_id", "p.path", "p.rule")


_DECIDED = """k AS (SELECT doc_id AS id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id), n AS (SELECT doc_id AS id, length(lang) % 2 AS q, 0 AS x FROM documents)"""


def _imports(t):
    known = t("labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("q"), F.max("toxic").cast("int").alias("x"))
    new = t("documents").select(F.col("doc_id").alias("id"), (F.length("lang") % 2).cast("int").alias("q"), F.lit(0).alias("x"))
    return runs.merge_decisions(known, new)


@query(f"WITH {_DECIDED} SELECT coalesce(k.id, n.id) AS id, coalesce(k.q, n.q)::INT AS q, coalesce(k.x, n.x)::INT AS x FROM k FULL JOIN n ON k.id = n.id")
def decisions_merged(t):
    return _imports(t)[0]


@query(f"WITH {_DECIDED} SELECT n.id FROM n JOIN k ON k.id = n.id WHERE (n.q, n.x) <> (k.q, k.x)")
def decision_conflicts(t):
    return _imports(t)[1].select("id")


@query("SELECT doc_id AS id, 'b' || doc_id AS binding, NULL::BOOLEAN AS subject_equivalent, 0::BIGINT AS quotation_errors FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def review_templates(t):
    from ..operators.datasets import review_template

    pending = joins.missing(t("documents").select("doc_id"), t("labels"), "doc_id").select(F.col("doc_id").alias("id"), F.concat(F.lit("b"), "doc_id").alias("answer_binding"))
    return review_template(pending).select("id", "binding", "subject_equivalent", F.size("quotation_errors").cast("long").alias("quotation_errors"))
