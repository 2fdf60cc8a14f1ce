"""Runs: gates before publication, identities, limits, journals, sessions and their recovery."""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finite, json_quoted
from .joins import merge
from .rules import Rule, violations

# States of a journal, interruptions, counters of a memory sample, evidence of a decision.
TERMINAL = ("COMPLETE", "LENGTH_STOP", "TIMEOUT", "FAILED")
INTERRUPTED = ("TIME_LIMIT", "HOST_MEMORY_LIMIT", "USER_STOP")
MEMORY = ("allocated_bytes", "reserved_bytes", "peak_allocated_bytes", "peak_reserved_bytes", "free_device_bytes")


def named_packets(approvals: DataFrame, key: str = "approval_id", ids: str = "packet_ids") -> DataFrame:
    """(approval_id, place, packet_id): the packets that approvals name in a list, a row each."""
    return approvals.select(key, F.posexplode(ids).alias("place", "packet_id"))


def acceptance_problems(approvals: DataFrame, named: DataFrame, packets: DataFrame) -> DataFrame:
    """(approval_id, rule) of approvals that do not accept just what was reviewed.

    approvals: approval_id, decision, export_sha256, review_sha256, reviewer, accepted_at; named: as
    named_packets() gives them, so that an approval of any size is no one row; packets: packet_id, reviewed, input_binding, rebuilt_binding.
    """
    c = F.col
    times = named.groupBy("approval_id", "packet_id").agg(F.count("*").alias("times"))
    sizes = times.groupBy("approval_id").agg(F.max("times").alias("most"))
    own = F.array_compact(F.array(
        F.when(~c("decision").eqNullSafe(F.lit("ACCEPTED")), F.lit("not_accepted")), F.when(~c("export_sha256").eqNullSafe(c("review_sha256")), F.lit("review_changed")),
        F.when(F.coalesce(c("reviewer"), F.lit("")) == "", F.lit("no_reviewer")), F.when(F.try_to_date("accepted_at", "yyyy-MM-dd").isNull(), F.lit("no_date")),
        F.when(c("most").isNull(), F.lit("no_packets")), F.when(c("most") > 1, F.lit("packet_twice")),
    ))
    told = approvals.join(sizes, "approval_id", "left").select("approval_id", F.explode(own).alias("rule"))
    each = times.join(packets, "packet_id", "left")
    state = F.when(c("input_binding").isNull(), "unknown_packet").when(~F.coalesce(c("reviewed"), F.lit(False)), "not_reviewed").when(~c("input_binding").eqNullSafe(c("rebuilt_binding")), "binding_changed")
    return told.unionByName(each.select("approval_id", state.alias("rule")).where("rule is not null").distinct())


def protocol_rules(version: str, scorer: str) -> list[Rule]:
    """Rules of a test protocol (schema, examples, filing_years array, standardized_years array, scorer_version)."""
    years, some = F.col("filing_years"), F.col("standardized_years")
    return [
        Rule("schema", ~F.col("schema").eqNullSafe(F.lit(version)), "unknown protocol"),
        Rule("scorer", ~F.col("scorer_version").eqNullSafe(F.lit(scorer)), "another scorer"),
        Rule("years", F.coalesce(F.size(years) < 1, F.lit(True)) | (F.size(F.array_distinct(years)) < F.size(years)), "years are missing or repeat"),
        Rule("count", F.col("examples") != F.size(years), "examples and years differ in number"),
        Rule("subset", F.size(F.array_except(some, years)) > 0, "standardized years outside the filing years"),
    ]


def decision_rules() -> list[Rule]:
    """Rules of a review decision joined with its binding, quotable paths and the named cell's text (`cell`)."""
    return [
        Rule("binding", ~F.col("binding").eqNullSafe(F.col("answer_binding")), "bound to another answer"),
        Rule("quotes", F.size(F.array_except("quotation_errors", "quotable_paths")) > 0, "a quoted path does not exist"),
        Rule("evidence", F.col("subject_equivalent") & ~F.coalesce(F.contains("cell", F.col("passage")) & (F.length("passage") > 0), F.lit(False)), "the passage is not in the named cell"),
    ]


def update_rules() -> list[Rule]:
    """Rules of an update event."""
    counters = ("global_step", "sample_position", "nonpadding_tokens", "supervised_tokens")
    return [
        *[Rule(f"count_{x}", F.col(x).isNull() | (F.col(x) < 0), "not a count", x) for x in counters],
        Rule("supervised", F.col("supervised_tokens") > F.col("nonpadding_tokens"), "more supervised than real tokens", "supervised_tokens"),
        Rule("seconds", ~finite(F.col("full_loop_seconds")) | (F.col("full_loop_seconds") < 0), "no such time", "full_loop_seconds"),
        Rule("compute", F.col("compute_seconds").isNotNull() & (~finite(F.col("compute_seconds")) | (F.col("compute_seconds") < 0)), "no such time", "compute_seconds"),
        Rule("timing", ~F.col("compute_timing").isin("host_wall", "device_events", "synchronized_wall"), "unknown timing", "compute_timing"),
    ]


def memory_rules() -> list[Rule]:
    """Rules of a memory sample; its window must be open."""
    return [
        *[Rule(f"count_{x}", F.col(x).isNull() | (F.col(x) < 0), "not a count", x) for x in MEMORY],
        *[Rule(f"peak_{x}", F.col(f"peak_{x}_bytes") < F.col(f"{x}_bytes"), "a peak below its value", f"peak_{x}_bytes") for x in ("allocated", "reserved")],
        Rule("window", F.col("window_label").isNull(), "no window is open", "window_label"),
    ]


def progress_rules() -> list[Rule]:
    """Rules of progress counts with those of the row before (previous_completed, previous_failed)."""
    c = F.col
    return [
        Rule("bounds", ~F.coalesce((c("failed") >= 0) & (c("failed") <= c("completed")) & (c("completed") <= c("total")), F.lit(False)), "counts out of order"),
        Rule("monotonic", (c("completed") < c("previous_completed")) | (c("failed") < c("previous_failed")), "a count fell"),
    ]


def identity_state(before: Column, after: Column) -> tuple[Column, Column]:
    """MATCH, CHANGED or UNVERIFIED of two map<string,string> identities, and the sorted keys that differ.

    A side that is null or has a null value can't be verified, unless some known value differs.
    """
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    changed = F.filter(keys, lambda k: F.try_element_at(before, k).isNotNull() & F.try_element_at(after, k).isNotNull() & (F.try_element_at(before, k) != F.try_element_at(after, k)))
    open_ = F.exists(keys, lambda k: F.try_element_at(before, k).isNull() | F.try_element_at(after, k).isNull())
    return F.when(before.isNull() | after.isNull(), "UNVERIFIED").when(F.size(changed) > 0, "CHANGED").when(open_, "UNVERIFIED").otherwise("MATCH"), changed


def limit_reason(below_count: Column, phase_seconds: Column, total_seconds: Column, *, samples: int, phase_limit: float, total_limit: float) -> Column:
    """Why a run must stop, the first reason that holds; null while it may go on."""
    return F.when(below_count >= samples, "HOST_MEMORY_LIMIT").when(phase_seconds >= phase_limit, "PHASE_TIMEOUT").when(total_seconds >= total_limit, "AGGREGATE_TIMEOUT")


def table_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted as a multiset, with `side` and `n`."""
    names = before.columns
    tagged = before.withColumn("_n", F.lit(1)).unionByName(after.withColumn("_n", F.lit(-1)))
    net = tagged.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return net.select(*names, F.when(F.col("_n") > 0, "before").otherwise("after").alias("side"), F.abs("_n").alias("n"))


def out_of_order(rows: DataFrame, keys: list[str], order: list, reference: DataFrame, item: str, position: str) -> DataFrame:
    """Rows whose item does not stand after the one before it in the reference order, or not in it at all."""
    placed = rows.join(reference.select(item, position), item, "left")
    before = F.lag(position).over(Window.partitionBy(*keys).orderBy(*order))
    return placed.withColumn("_before", before).where(F.col(position).isNull() | (F.col("_before") >= F.col(position))).drop("_before")


def epoch_orders(seed: int, count: int, epochs: int) -> Iterator[tuple[int, int, int]]:
    """(epoch, place, position) of one seeded permutation after the other; computed on the driver, as the
    generator's sequence is the contract. count is a number of examples, not of corpus rows."""
    rng = random.Random(seed)
    for epoch in range(epochs):
        order = list(range(count))
        rng.shuffle(order)
        for place, position in enumerate(order):
            yield epoch, place, position


def journal_states(journal: DataFrame, run: str = "run", position: str = "position") -> DataFrame:
    """(run, status, may_resume): the last state of each run; only a clean stop may go on."""
    last = journal.groupBy(run).agg(F.max_by("status", position).alias("status"))
    return last.select(run, "status", (F.col("status") == "CLEAN_STOP").alias("may_resume"))


def attributed(requests: DataFrame, captured: DataFrame, ends: DataFrame, session: str = "session", index: str = "index") -> DataFrame:
    """A status for every request of a session: its captured one, or what its session's end means for it.

    captured: session, index, status; ends: session, active_index, reason. Only the active request of an
    ended session fails; a user's stop leaves it pending like all others.
    """
    both = requests.join(captured.select(session, index, F.col("status").alias("own")), [session, index], "left").join(ends, session, "left")
    active = F.col(index).eqNullSafe(F.col("active_index"))
    status = F.when(F.col("own").isNotNull(), F.col("own")).when(active & (F.col("reason") == "TIME_LIMIT"), "TIMEOUT").when(active & ~F.col("reason").isin(*INTERRUPTED), "FAILED").otherwise("PENDING")
    return both.select(*requests.columns, status.alias("status"))


def settled_charges(ledger: DataFrame, execution: str = "execution_id") -> DataFrame:
    """One row for each execution: its settled seconds, or, once, the reserved ones of an abandoned execution.

    ledger: execution_id, status (STARTED with the reservation, or the outcome), elapsed_seconds.
    """
    done = F.col("status") != "STARTED"
    total = ledger.groupBy(execution).agg(F.max(F.when(done, F.col("elapsed_seconds"))).alias("settled"), F.max(F.when(~done, F.col("elapsed_seconds"))).alias("reserved"), F.count_if(done).alias("outcomes"))
    return total.select(execution, F.coalesce("settled", "reserved").alias("charged"), (F.col("outcomes") == 0).alias("abandoned"), (F.col("outcomes") > 1).alias("settled_twice"))


def change_log(revisions: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, order, before, after) wherever a revision's value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    each = revisions.select(*keys, order, F.lag(value).over(w).alias("before"), F.col(value).alias("after"), F.row_number().over(w).alias("_n"))
    return each.where((F.col("_n") > 1) & ~F.col("before").eqNullSafe(F.col("after"))).drop("_n")


def revealed(fields: DataFrame, drafts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Fields with drafts put in only where the user left nothing, and the value before."""
    both = fields.join(drafts.select(*keys, F.col(value).alias("draft")), keys, "left")
    return both.select(*keys, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("draft")).alias(value), F.col(value).alias("before"))


def retained(selections: DataFrame, documents: DataFrame) -> DataFrame:
    """Selections with the content that a manifest embeds under their path and hash; null where none has it.

    documents: source_path, source_sha256, content, a row for each document of a manifest, so that no manifest is one row.
    """
    return selections.join(documents.dropDuplicates(["source_path", "source_sha256"]), ["source_path", "source_sha256"], "left")


def rebuilt_differences(saved: DataFrame, rebuilt: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) where a saved packet is not what its selection gives anew, or one side is missing."""
    a = saved.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rebuilt.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    differ = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]
    return a.join(b, key, "full_outer").select(key, F.explode(F.array_compact(F.array(*differ))).alias("column"))


def stopped_status(status: Column, stop_type: Column) -> Column:
    """A termination mismatch at the token limit is a length stop."""
    return F.when((status == "TERMINATION_MISMATCH") & (stop_type == "limit"), "LENGTH_STOP").otherwise(status)


def summary(report: DataFrame) -> DataFrame:
    """status, targets, counts and the ratio of correct cases of a report row; no ratio without valid accuracy."""
    done = F.col("status") == "COMPLETE"
    ratio = F.when(done & (F.col("targets") > 0), F.col("correct") / F.col("targets"))
    return report.select("status", "targets", "format_valid", "correct", ratio.alias("ratio"), F.when(done, 0).when(F.col("status") == "PENDING_REVIEW", 2).otherwise(1).alias("exit_code"))


def run_status(worker_status: Column, exit_code: Column, saved_status: Column) -> Column:
    """The worker's status, or the saved result's once the worker exited cleanly."""
    return F.when((exit_code == 0) & saved_status.isNotNull(), saved_status).otherwise(worker_status)


# Which states of a journal may follow which; none may come first but READY.
FOLLOWS = {"READY": ("UPDATING", "CLEAN_STOP"), "UPDATING": ("BOUNDARY",), "BOUNDARY": ("UPDATING", "CLEAN_STOP", "TRAINED"), "CLEAN_STOP": ("READY",), "TRAINED": ()}


def journal_problems(journal: DataFrame, run: str = "run", position: str = "position") -> DataFrame:
    """(run, position, rule) of journal rows (status, completed) that may not follow the row before."""
    w = Window.partitionBy(run).orderBy(position)
    before = F.lag("status").over(w)
    each = journal.select(run, position, "status", "completed", before.alias("was"), F.lag("completed").over(w).alias("had"))
    allowed = F.create_map(*[x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    c = F.col
    broken = F.array_compact(F.array(
        F.when(~c("status").isin(*FOLLOWS), "unknown_state"), F.when(c("was").isNull() & (c("status") != "READY"), "not_begun"),
        F.when(c("was").isin(*FOLLOWS) & ~F.coalesce(F.array_contains(allowed[c("was")], c("status")), F.lit(False)), "transition"), F.when(c("completed") < c("had"), "fell_back"),
    ))
    return each.select(run, position, F.explode(broken).alias("rule"))


def ledger_seconds(ledger: DataFrame, keys: list[str], seconds: str, phase: Column, failed: Column) -> DataFrame:
    """(keys, total, in_phase, failed): seconds of a ledger, those of one phase, those of failed executions."""
    part = lambda c: F.sum(F.when(c, F.col(seconds)))
    return ledger.groupBy(*keys).agg(F.sum(seconds).alias("total"), part(phase).alias("in_phase"), part(failed).alias("failed"))


def stage_totals(calls: DataFrame, stage: str, seconds: str, failed: Column) -> DataFrame:
    """(stage, seconds, calls, failed_calls). Stages nest, so their seconds don't add up."""
    return calls.groupBy(F.col(stage).alias("stage")).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("calls"), F.count_if(failed).alias("failed_calls"))


def inventory_hash(files: DataFrame, keys: list[str], path: str = "path", sha256: str = "sha256") -> DataFrame:
    """(keys, files, inventory_sha256): the hash of a folder's sorted path-to-hash map, in the binding's JSON."""
    pair = F.concat(json_quoted(F.col(path)), F.lit(": "), json_quoted(F.col(sha256)))
    listed = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), pair.alias("t"))))
    told = F.concat(F.lit("{"), F.array_join(F.transform(listed, lambda x: x["t"]), ", "), F.lit("}"))
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sha2(told, 256).alias("inventory_sha256"))


def chain(records: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Records of a publication joined by hash: each one's `needs` is the `makes` of the one before.

    records: (rows, needs, makes), the first without needs. The result has the columns of all.
    """
    found, _, made = records[0]
    for rows, needs, makes in records[1:]:
        found = found.join(rows, F.col(made) == F.col(needs))
        made = makes
    return found


def chain_problems(records: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(record, key, rule) of what breaks a publication's chain: records that nothing before them made (unbound), and made ones that none needs (unused).

    records: (name, rows, needs, makes), as chain() takes them. Keys are told as text, each once; a null key is unbound, and makes nothing.
    """
    c, parts = F.col, []
    keys = lambda rows, name: rows.select(c(name).cast("string").alias("key")).distinct()
    for (before, made, _, makes), (name, rows, needs, _) in zip(records, records[1:]):
        given, wanted = keys(made, makes), keys(rows, needs)
        parts.append(wanted.join(given, "key", "left_anti").select(F.lit(name).alias("record"), "key", F.lit("unbound").alias("rule")))
        parts.append(given.where("key is not null").join(wanted, "key", "left_anti").select(F.lit(before).alias("record"), "key", F.lit("unused").alias("rule")))
    return functools.reduce(DataFrame.unionByName, parts)


def decision_problems(decisions: DataFrame, answers: DataFrame, cells: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, rule) of review decisions.

    decisions: id, binding, reviewed, subject_equivalent, block_index, cell_index, passage, reason,
    quotation_errors; answers: id, answer_binding of valid answers; cells: id, block_index, cell_index, text;
    quotes: id, path of the answers' wordings. The named cell comes by an equi join on its place.
    """
    c = F.col
    cell = cells.select("id", "block_index", "cell_index", c("text").alias("cell"))
    paths = quotes.groupBy("id").agg(F.collect_set("path").alias("quotable_paths"))
    both = decisions.join(answers.select("id", "answer_binding"), "id", "left").join(cell, ["id", "block_index", "cell_index"], "left").join(paths, "id", "left")
    both = both.withColumn("quotable_paths", F.coalesce("quotable_paths", F.array().cast("array<string>")))
    more = [Rule("reviewed", ~F.coalesce("reviewed", F.lit(False)) | c("subject_equivalent").isNull(), "not decided"),
            Rule("reason", c("subject_equivalent") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "no reason")]
    return violations(both, "id", decision_rules() + more).select(c("entity_id").alias("id"), c("rule_id").alias("rule"))


def merge_decisions(known: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions by id after an import, and conflicts: the same decision again changes nothing, another one is refused.

    Both have an id; all their other columns are the decision.
    """
    names = [x for x in known.columns if x != "id"]
    told = lambda df: df.select("id", F.struct(*names).alias("decision"))
    merged, clash = merge(told(known), told(new), "id", "decision")
    return merged.select("id", "decision.*"), clash


# The longest session and the longest review, in seconds and minutes.
SESSION_SECONDS, REVIEW_MINUTES = 1800, 240


def review_draft_problems(drafts: DataFrame, packets: DataFrame, fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """(session_id, rule) of saved review drafts.

    drafts: session_id, set_id, schema, own_set, own_schema, active_seconds, prior_minutes; packets: session_id,
    packet_id, known (it is in the set), input_binding, own_binding, reviewed; fields: session_id, packet_id,
    availability; corrections: session_id, packet_id, reason.
    """
    c, empty = F.col, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    out_of = lambda x, top: ~F.coalesce(F.col(x).between(0, top), F.lit(False))
    own = drafts.select("session_id", F.explode(F.array_compact(F.array(
        F.when(~c("set_id").eqNullSafe(c("own_set")) | ~c("schema").eqNullSafe(c("own_schema")), "another_set"), F.when(out_of("active_seconds", SESSION_SECONDS), "session_time"), F.when(out_of("prior_minutes", REVIEW_MINUTES), "review_time"),
    ))).alias("rule"))
    each = packets.select("session_id", F.explode(F.array_compact(F.array(F.when(~F.coalesce("known", F.lit(False)), "unknown_packet"), F.when(~c("input_binding").eqNullSafe(c("own_binding")), "binding_changed")))).alias("rule"))
    keys = ["session_id", "packet_id"]
    reviewed = packets.where("reviewed").select(*keys)
    open_ = fields.where(empty("availability")).unionByName(corrections.where(empty("reason")), allowMissingColumns=True).join(reviewed, keys, "left_semi")
    return own.unionByName(each).unionByName(open_.select("session_id", F.lit("reviewed_but_open").alias("rule"))).distinct()


def stop_reason(seconds_since_sample: Column, below_count: Column, phase_seconds: Column, total_seconds: Column, *, stale: float, samples: int, phase_limit: float, total_limit: float) -> Column:
    """limit_reason(), after a sampler that has been silent too long."""
    return F.when(seconds_since_sample > stale, "STALE_SAMPLES").otherwise(limit_reason(below_count, phase_seconds, total_seconds, samples=samples, phase_limit=phase_limit, total_limit=total_limit))
