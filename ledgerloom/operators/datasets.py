"""Datasets as tables: the reader's audit, test eligibility, provider families, drafts, imports, reviews."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import digest, encode, parsed
from ..functions.text import casefold, collapse, json_quoted
from ..sources.files import registrant
from . import holdout, runs
from . import packets as packets_of
from .answers import messages, roles_hold
from .joins import supported
from ..sources.scratch import cut
from .labels import AVAILABILITY, CONTRACT, label_problems, quotations
from .rules import duplicates, require_empty, violations

FAMILY = "^family-[a-z0-9]+(-[a-z0-9]+)*$"
MESSAGES = "struct<messages:array<struct<role:string,content:string>>>"


def _rules(df: DataFrame, key: str, found: dict[str, Column]) -> DataFrame:
    """(key, rule) for each condition that holds; null is not broken."""
    return df.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]))).alias("rule"))


def dataset_problems(lines: DataFrame, examples: DataFrame, prompt: str, inputs: DataFrame) -> DataFrame:
    """(id, rule) of a dataset read back.

    lines: split, position, value (strict JSON of one example). examples: packet_id, split, position,
    row_sha256, selection_split. inputs: packet_id, model_input, rebuilt from the sources. Each line
    must have one example and each example one line; ids are packet ids, or split:position without one.
    """
    row = parsed(F.col("value"), "row")
    known = lines.select("split", "position", "value", row.alias("p"))
    ids = F.coalesce("packet_id", F.concat_ws(":", "split", "position"))
    repeated = examples.groupBy("split", "position").agg(F.count("*").alias("claims"))
    both = known.join(examples.join(repeated, ["split", "position"]), ["split", "position"], "full_outer").join(inputs, "packet_id", "left")
    said = F.from_json(F.col("p.canonical"), MESSAGES)["messages"]
    each = both.withColumn("id", ids).withColumn("m", F.when(F.col("p.ok"), said))
    label = F.get("m", F.lit(2))["content"]
    each = each.withColumn("wrong", F.when(F.size("m") == 3, F.size(label_problems(label))))
    return _rules(each, "id", {
        "no_row": F.col("value").isNull(), "no_example": F.col("claims").isNull(), "position_twice": F.col("claims") > 1, "not_json": ~F.col("p.ok"),
        "content_changed": F.col("p.ok") & (F.col("p.sha256") != F.col("row_sha256")), "split_differs": F.col("selection_split") != F.col("split"),
        "roles": F.col("p.ok") & ~F.coalesce(roles_hold(F.col("m")), F.lit(False)), "prompt": F.get("m", F.lit(0))["content"] != F.lit(prompt),
        "input_differs": ~F.get("m", F.lit(1))["content"].eqNullSafe(F.col("model_input")) & F.col("claims").isNotNull() & F.col("m").isNotNull(), "label": F.col("wrong") > 0,
    }).distinct()


def eligibility_problems(selections: DataFrame, inventory: DataFrame, prior: DataFrame, cells: DataFrame, standardized: list[int]) -> DataFrame:
    """(packet_id, rule) of test selections that may not be used.

    selections: packet_id, split, accession, group_id, source_path, source_sha256, source_url, cik,
    filing_date, standardized_format, evidence array, independence_review. inventory: path, sha256,
    locations array of (accession, filing_date, sec_url, cik). prior: (kind, key) of everything known
    before. cells: packet_id, text. No selection may share a key with prior ones or another selection.
    """
    c = F.col
    where = inventory.select(c("path").alias("source_path"), c("sha256").alias("source_sha256"), F.explode("locations").alias("l"))
    admitted = where.select("source_path", "source_sha256", *[c(f"l.{x}").alias(y) for x, y in (("accession", "accession"), ("filing_date", "filing_date"), ("sec_url", "source_url"), ("cik", "cik"))])
    home = selections.join(admitted.distinct(), admitted.columns, "left_semi").select("packet_id", F.lit(True).alias("home"))
    kinds = {"accession": "accession", "group": "group_id", "hash": "source_sha256", "cik": "cik"}
    keys = selections.select("packet_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(x).alias("key")) for k, x in kinds.items()])).alias("k")).select("packet_id", "k.*").where("key is not null")
    known = keys.join(prior.select("kind", "key"), ["kind", "key"], "left_semi").select("packet_id", F.lit("known_before").alias("rule"))
    shared = keys.join(keys.groupBy("kind", "key").agg(F.count_distinct("packet_id").alias("n")).where("n > 1"), ["kind", "key"], "left_semi").select("packet_id", F.lit("not_distinct").alias("rule"))
    text = lambda x: F.lower(collapse(x))
    held = cells.groupBy("packet_id").agg(F.collect_list(text(c("text"))).alias("cells"))
    year = F.year(F.try_to_date("filing_date", "yyyy-MM-dd"))
    found = F.forall(c("evidence"), lambda e: (text(e) != "") & F.exists(c("cells"), lambda x: F.contains(x, text(e))))
    both = selections.join(home, "packet_id", "left").join(held, "packet_id", "left").withColumn("year", year)
    in_form = c("year").isin(*standardized) if standardized else F.lit(False)
    own = _rules(both, "packet_id", {
        "storage": ~c("split").eqNullSafe(F.lit("test")) | ~F.coalesce(c("source_path").startswith("data/raw/test/"), F.lit(False)), "not_admitted": c("home").isNull(),
        "identity": c("cik").isNull() | ~F.coalesce(c("accession").rlike("^[0-9]{10}-[0-9]{2}-[0-9]{6}$"), F.lit(False)),
        "year": c("year").isNull() | (F.substring("accession", 12, 2).try_cast("int") != F.pmod("year", F.lit(100))),
        "no_evidence": in_form & (~F.coalesce("standardized_format", F.lit(False)) | (F.coalesce(F.size("evidence"), F.lit(0)) < 1)),
        "evidence_absent": in_form & (F.size("evidence") > 0) & ~F.coalesce(found, F.lit(False)), "independence": F.coalesce("independence_review", F.lit("")) == "",
    })
    return own.unionByName(known).unionByName(shared).distinct()


def family_problems(prior: DataFrame, expected: DataFrame, candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """(id, rule) of an audit of provider families.

    prior: id, family_ids array, n_evidence; expected: id of all prior sources and assignments;
    candidates: accession, family_id, cik, sha256 array, n_evidence, foreign_evidence (evidence of another
    filing); selections: accession, family_id, cik, source_sha256.
    """
    c = F.col
    cover = prior.select("id", F.lit(1).alias("p")).join(expected.select("id", F.lit(1).alias("e")), "id", "full_outer").where("p is null or e is null").select("id", F.lit("coverage").alias("rule"))
    old = _rules(prior, "id", {
        "families": (F.coalesce(F.size("family_ids"), F.lit(0)) < 1) | ~F.coalesce(F.forall("family_ids", lambda f: f.rlike(FAMILY)), F.lit(False)), "no_evidence": F.coalesce("n_evidence", F.lit(0)) < 1,
    })
    taken = prior.select(F.explode("family_ids").alias("family_id")).distinct().withColumn("taken", F.lit(True))
    several = selections.groupBy("family_id").agg(F.count("*").alias("n"))
    named = candidates.select("accession", *[c(x).alias(f"c_{x}") for x in ("family_id", "cik", "sha256", "n_evidence", "foreign_evidence")])
    both = selections.join(named, "accession", "left").join(taken, "family_id", "left").join(several, "family_id", "left").withColumn("id", c("accession"))
    same = c("family_id").rlike(FAMILY) & (c("c_family_id") == c("family_id")) & c("c_cik").eqNullSafe(c("cik")) & F.array_contains("c_sha256", c("source_sha256"))
    new = _rules(both, "id", {
        "differs_from_audit": ~F.coalesce(same, F.lit(False)), "family_overlaps": c("taken") | (c("n") > 1), "no_evidence": F.coalesce("c_n_evidence", F.lit(0)) < 1, "foreign_evidence": c("c_foreign_evidence") > 0,
    })
    return cover.unionByName(old).unionByName(new)


_DRAFT_PARTS = ("value", "raw_text", "availability", "origin", "evidence_input", "note")
_DRAFT_ORIGINS = ("", "EXTRACTED", "DERIVED", "INFERRED")


def draft_problems(packets: DataFrame, drafts: DataFrame) -> DataFrame:
    """(packet_id, rule) of suggested drafts that don't belong to just these packets.

    packets and drafts: packet_id, source_sha256, packet_version, packet_fingerprint, input_binding;
    drafts also fields, JSON text of the fourteen fields.
    """
    bound = ("source_sha256", "packet_version", "packet_fingerprint", "input_binding")

    @F.pandas_udf("string")
    def fields_rule(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                fields = json.loads(t)
                if fields.keys() != CONTRACT.keys():
                    return "fields"
                parts = [f.get(p) for f in fields.values() for p in _DRAFT_PARTS]
                if not all(isinstance(x, str) for x in parts):
                    return "not_text"
                known = all(f["availability"] in AVAILABILITY and f["origin"] in _DRAFT_ORIGINS for f in fields.values())
                return None if known else "unknown_state"
            except (TypeError, ValueError, AttributeError):
                return "fields"

        return texts.map(one)

    a = packets.select("packet_id", F.struct(*bound).alias("a"))
    b = drafts.select("packet_id", F.struct(*bound).alias("b"), fields_rule("fields").alias("wrong"))
    both = a.join(b, "packet_id", "full_outer")
    rule = F.when(F.col("a").isNull(), "unknown_packet").when(F.col("b").isNull(), "no_draft").when(F.col("a") != F.col("b"), "another_version").otherwise(F.col("wrong"))
    return both.select("packet_id", rule.alias("rule")).where("rule is not null")


LOCATION = ("sec_url", "original_filename", "accession", "retrieval_date", "filing_date", "form", "cik")


def imported(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """The inventory (sha256, path, bytes, locations, release) with files (sha256, path, bytes, LOCATION fields).

    Equal bytes are one entry; a new place of theirs is one more location; new entries are held for
    a release review. A repeated import changes nothing.
    """
    new = files.groupBy("sha256").agg(F.min("path").alias("path"), F.min("bytes").alias("bytes"), F.array_sort(F.collect_set(F.struct(*LOCATION))).alias("locations"))
    a, b = inventory.select("sha256", F.struct("path", "bytes", "locations", "release").alias("a")), new.select("sha256", F.struct("path", "bytes", "locations").alias("b"))
    both, c = a.join(b, "sha256", "full_outer"), F.col
    places = F.when(c("b").isNull(), c("a.locations")).when(c("a").isNull(), c("b.locations")).otherwise(F.concat(c("a.locations"), F.array_except(c("b.locations"), c("a.locations"))))
    return both.select("sha256", F.coalesce("a.path", "b.path").alias("path"), F.coalesce("a.bytes", "b.bytes").alias("bytes"), places.alias("locations"), F.coalesce("a.release", F.lit("held")).alias("release"))


def name_clashes(files: DataFrame, path: str = "path") -> DataFrame:
    """Names that differ in case alone, under full case folding."""
    return files.groupBy(casefold(path).alias("folded")).agg(F.count_distinct(path).alias("names")).where("names > 1")


def accepted(named: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets in the order in which an approval names them (place, packet_id), with their position in their split."""
    from .ordered import positions

    return positions(named.select("place", "packet_id").join(packets, "packet_id"), ["split"], ["place"])


def review_template(pending: DataFrame) -> DataFrame:
    """A decision row to fill in for each pending case (id, answer_binding)."""
    none = F.lit(None)
    return pending.select("id", F.col("answer_binding").alias("binding"), none.cast("boolean").alias("subject_equivalent"), none.cast("int").alias("block_index"), none.cast("int").alias("cell_index"),
                          none.cast("string").alias("passage"), F.array().cast("array<string>").alias("quotation_errors"))


def packet_binding(manifest: dict, source_view: str, model_input: str) -> dict:
    """The three hashes that tie a review to a packet."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {"binding_version": "review-binding-v1", "manifest_sha256": sha(encode(manifest, "target")), "review_view_sha256": sha(source_view), "model_input_sha256": sha(model_input)}


def answer_binding(identity: str, case: dict, answer: dict) -> str:
    """Hash that ties a decision to an exact answer."""
    return digest({"identity": identity, "case": case, "answer": answer}, "binding")


def packet_bindings(packets: DataFrame) -> DataFrame:
    """packet_binding() of packets (packet_id, manifest JSON, source_view, model_input), as columns."""
    sha = lambda c: F.sha2(c, 256)
    return packets.select("packet_id", F.lit("review-binding-v1").alias("binding_version"), parsed(F.col("manifest"), "target")["sha256"].alias("manifest_sha256"), sha("source_view").alias("review_view_sha256"), sha("model_input").alias("model_input_sha256"))


def answer_bindings(answers: DataFrame, identity: str) -> DataFrame:
    """(id, answer_binding) of answers (id, case_json, answer_json), as answer_binding() has it."""
    told = F.concat(F.lit('{"identity":'), json_quoted(F.lit(identity)), F.lit(',"case":'), F.col("case_json"), F.lit(',"answer":'), F.col("answer_json"), F.lit("}"))
    return answers.select("id", parsed(told, "binding")["sha256"].alias("answer_binding"))


def candidate_ciks(selections: DataFrame, inventory: DataFrame) -> DataFrame:
    """Selections (packet_id, source_path, source_url, cik) with `ciks`, every registrant that they or the
    inventory's locations (path, locations array of (cik, sec_url)) tie to their path, and whether an own one differs from its URL."""
    key, differ = registrant(F.col("cik"), F.col("source_url"))
    at = inventory.select(F.col("path").alias("source_path"), F.explode("locations").alias("l"))
    other, _ = registrant(F.col("l.cik"), F.col("l.sec_url"))
    known = at.select("source_path", other.alias("k")).where("k is not null").groupBy("source_path").agg(F.collect_set("k").alias("known"))
    both = selections.withColumn("_own", key).withColumn("cik_differs", differ).join(known, "source_path", "left")
    own = F.when(F.col("_own").isNull(), F.array().cast("array<string>")).otherwise(F.array("_own"))
    return both.withColumn("ciks", F.array_sort(F.array_union(own, F.coalesce("known", F.array().cast("array<string>"))))).drop("_own", "known")


#: Columns of a packet that its selection does not have.
DERIVED = ("blocks", "packet_version", "view_version", "target_id")


def recovered(packets: DataFrame) -> DataFrame:
    """The selections that packets were made from."""
    return packets.drop(*DERIVED)


def session_requests(cases: DataFrame) -> DataFrame:
    """What a worker may see of cases: no reference, no cells."""
    return cases.select("id", "messages")


def complete_imports(files: DataFrame) -> DataFrame:
    """(path, rule): files of an import that are not whole, are stored outside their partition, or clash by name.

    files: path, complete, split, folder (of the split).
    """
    clash = name_clashes(files).select("folded", F.lit(True).alias("clash"))
    both = files.withColumn("folded", casefold("path")).join(clash, "folded", "left")
    return _rules(both, "path", {"not_complete": ~F.coalesce("complete", F.lit(False)), "other_partition": ~F.startswith("path", "folder"), "name_clash": F.col("clash")})


def prepared(selections: DataFrame, sources: DataFrame, assignments: DataFrame, ledger: DataFrame, contexts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Packets of selections, and what forbids them: (packet_id, rule).

    The chain of a review's preparation: rules of selections, assignments and protected sources, then
    (packet_id, target_id, model_input). Ordinary preparation takes no test selections.
    """
    whole = packets_of.with_source(selections, sources)
    told = violations(whole, "packet_id", packets_of.selection_rules()).select(F.col("entity_id").alias("packet_id"), F.col("rule_id").alias("rule"))
    test = selections.where("split = 'test'").select("packet_id", F.lit("protected_split").alias("rule"))
    twice = duplicates(selections, "packet_id").select("packet_id", F.lit("packet_twice").alias("rule"))
    tied = holdout.protected_selections(selections, ledger).select("packet_id", F.lit("protected_source").alias("rule"))
    wrong = told.unionByName(test).unionByName(twice).unionByName(tied).unionByName(holdout.selection_problems(selections, assignments))
    found = packets_of.packet_blocks(whole)
    told_contexts = None if contexts is None else packets_of.context_blocks(contexts, selections.select("packet_id", F.col("accession").alias("own_accession")))
    if told_contexts is not None:
        wrong = wrong.unionByName(told_contexts[1].select("packet_id", F.lit("context_refused").alias("rule")))
    inputs = packets_of.model_inputs(found, None if told_contexts is None else told_contexts[0])
    ids = selections.select("packet_id", packets_of.target_ids().alias("target_id"))
    return ids.join(inputs, "packet_id"), wrong.distinct()


def publish_packets(packets: DataFrame, prompt: str, path: str, problems: DataFrame, manifest: dict | None = None) -> dict:
    """Writes a packet set (packet_id, target_id, model_input), its prompt and its bindings into a new folder, if no
    rule is broken. The manifest, with the hashes of both, is written last and returned."""
    from ..sources.sinks import publish_once

    require_empty(problems)
    return publish_once(packets, path, {"system-prompt.txt": prompt}, manifest or {"schema": "packet-set-v1"}, ["packet_id", "target_id", "model_input"])


def accepted_rows(packets: DataFrame, review: DataFrame, approvals: DataFrame, named: DataFrame, prompt: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an accepted dataset, and what forbids them: (id, rule).

    packets: packet_id, split, model_input, cells array, rebuilt_binding; review: packet_id, reviewed,
    input_binding, label (JSON); approvals and named as acceptance_problems() takes them. Rows: packet_id, split, position,
    row (JSON of three messages), row_sha256; positions follow the approval's order in each split.
    """
    both = packets.join(review, "packet_id", "left")
    gate = runs.acceptance_problems(approvals, named, both).select(F.col("approval_id").cast("string").alias("id"), "rule")
    # Four uses, one computation.
    chosen = cut(both.join(named.select("packet_id").distinct(), "packet_id", "left_semi"))
    label = chosen.select(F.col("packet_id").alias("id"), F.explode(label_problems(F.col("label"))).alias("p")).select("id", F.concat(F.lit("label_"), F.col("p.rule")).alias("rule"))
    quotes = quotations(chosen, "packet_id", "label").join(chosen.select("packet_id", "cells"), "packet_id")
    loose = quotes.where(~F.coalesce(supported(F.col("quote"), F.col("cells")), F.lit(False))).select(F.col("packet_id").alias("id"), F.lit("unsupported_quotation").alias("rule"))
    placed = accepted(named, chosen)
    said = messages(F.lit(prompt), F.col("model_input"), F.col("label"))
    row = parsed(F.to_json(F.struct(said.alias("messages"))), "row")
    rows = placed.select("packet_id", "split", "position", row.alias("r")).select("packet_id", "split", "position", F.col("r.canonical").alias("row"), F.col("r.sha256").alias("row_sha256"))
    return rows, gate.unionByName(label).unionByName(loose).distinct()


def publish_test(rows: DataFrame, path: str, problems: DataFrame, evidence: dict[str, str]) -> dict:
    """Publishes an accepted test dataset with the review, approval and preparation texts it rests on, each with its hash."""
    import hashlib

    from ..sources.sinks import publish

    require_empty(problems)
    held = {k: {"content": v, "sha256": hashlib.sha256(v.encode()).hexdigest()} for k, v in sorted(evidence.items())}
    return publish(rows, path, more={"schema": "test-dataset-v1", "acceptance": held})
