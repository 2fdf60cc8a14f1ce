"""Telemetry, ledger and schedule queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, ordered, packets, rules, runs
from .audit import query


#: Events as updates: seconds in hundredths as integers, so that sums and rates are exact on any engine.
_UPDATES = "u AS (SELECT event_id, user_id, ts, event_type, value, CAST(floor(value * 100) AS BIGINT) AS cs, event_id % 97 AS tokens FROM events)"
_W = "PARTITION BY user_id ORDER BY ts, event_id"


def _updates(t):
    return t("events").select("event_id", "user_id", "ts", "event_type", "value", F.floor(F.col("value") * 100).cast("long").alias("cs"), (F.col("event_id") % 97).alias("tokens"))


ORDER = ("ts", "event_id")


@query(f"""WITH {_UPDATES}, w AS (SELECT event_id, sum(tokens) OVER l AS tokens, sum(cs) OVER l AS cs, count(*) OVER l AS updates FROM u WINDOW l AS ({_W} ROWS 11 PRECEDING))
SELECT event_id, updates, tokens::BIGINT AS tokens, cs::BIGINT AS cs, CASE WHEN cs <> 0 THEN tokens::DOUBLE / cs::DOUBLE END AS rate FROM w""")
def rolling_throughput(t):
    sums = {"tokens_12": F.col("tokens"), "cs_12": F.col("cs")}
    w = ordered.rolling(_updates(t), ["user_id"], list(ORDER), sums)
    return w.select("event_id", "updates", F.col("tokens_12").alias("tokens"), F.col("cs_12").alias("cs"), ordered.rate(F.col("tokens_12").cast("double"), F.col("cs_12").cast("double")).alias("rate"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_quantity AS DECIMAL(18, 2))) OVER w AS weighted,
  sum(CAST(l_quantity AS DECIMAL(18, 2))) OVER w AS weight FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity ROWS 11 PRECEDING)""")
def weighted_mean_12(t):
    price, quantity = (F.col(c).cast("decimal(18,2)") for c in ("l_extendedprice", "l_quantity"))
    sums = {"weighted": price * quantity, "weight": quantity}
    w = ordered.rolling(t("lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], sums)
    return w.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "weighted", "weight")


@query(f"SELECT * FROM (SELECT event_id, user_id, lag(event_id) OVER ({_W}) AS previous FROM events) WHERE previous >= event_id")
def monotonic_violations(t):
    return ordered.not_increasing(t("events"), ["user_id"], list(ORDER), "event_id").select("event_id", "user_id", "previous")


@query(f"""WITH {_UPDATES}, p AS (SELECT *, CASE WHEN row_number() OVER ({_W}) = 1 THEN 'first_update' ELSE 'steady_state' END AS update_period FROM u)
SELECT user_id, update_period, count(*) AS updates, sum(cs)::BIGINT AS cs, sum(tokens)::BIGINT AS tokens FROM p GROUP BY user_id, update_period""")
def first_vs_steady(t):
    return ordered.periods(_updates(t), ["user_id"], list(ORDER)).groupBy("user_id", "update_period").agg(F.count("*").alias("updates"), F.sum("cs").alias("cs"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {_UPDATES}, n AS (SELECT *, row_number() OVER ({_W}) AS step, first_value(cs) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS first_cs, sum(cs) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS total FROM u),
e AS (SELECT event_id, CASE WHEN step = 1 THEN total ELSE total - first_cs END::BIGINT AS later_cs, greatest(step - 1, 1)::BIGINT AS later_updates, greatest(100 - step, 0)::BIGINT AS updates_left FROM n)
SELECT *, CASE WHEN later_cs <> 0 THEN updates_left::DOUBLE * later_cs::DOUBLE / later_updates::DOUBLE END AS eta_cs FROM e""")
def eta_remaining(t):
    steps = ordered.positions(_updates(t), ["user_id"], list(ORDER)).withColumn("step", F.col("position") + 1)
    e = ordered.remaining(steps, ["user_id"], list(ORDER), "cs", "step", 100)
    d = {c: F.col(c).cast("double") for c in ("left", "later_seconds", "later_updates")}
    eta = F.when(F.col("later_seconds") != 0, d["left"] * d["later_seconds"] / d["later_updates"])
    return e.select("event_id", F.col("later_seconds").alias("later_cs"), "later_updates", F.col("left").alias("updates_left"), eta.alias("eta_cs"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey <= 330 THEN 1 WHEN o_orderkey <= 660 THEN 2 WHEN o_orderkey <= 5000 THEN 3 WHEN o_orderkey <= 12000 THEN 4 END AS epoch,
  CASE WHEN o_orderkey <= 330 THEN o_orderkey WHEN o_orderkey <= 660 THEN o_orderkey - 330 WHEN o_orderkey <= 5000 THEN o_orderkey - 660 WHEN o_orderkey <= 12000 THEN o_orderkey - 5000 END AS done FROM orders""")
def epoch_progress(t):
    e = ordered.epoch(F.col("o_orderkey"), [330, 660, 5000, 12000])
    return t("orders").select("o_orderkey", e["epoch"].alias("epoch"), e["done"].alias("done"))


@query(f"""WITH f AS (SELECT *, value < 20 AS low, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER ({_W}) AS island FROM events),
c AS (SELECT event_id, user_id, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS below_count FROM f)
SELECT event_id, user_id, below_count FROM c WHERE below_count >= 2""")
def consecutive_below(t):
    return ordered.runs_below(t("events"), ["user_id"], list(ORDER), F.col("value") < 20).where("limit").select("event_id", "user_id", "below_count")


@query(f"""WITH {_UPDATES} SELECT user_id, sum(cs)::BIGINT AS total, (sum(cs) FILTER (WHERE event_type = 'click'))::BIGINT AS in_phase,
  (sum(cs) FILTER (WHERE value < 10))::BIGINT AS failed FROM u GROUP BY user_id""")
def ledger_totals(t):
    return runs.ledger_seconds(_updates(t), ["user_id"], "cs", F.col("event_type") == "click", F.col("value") < 10)


@query(f"WITH {_UPDATES} SELECT event_type AS stage, sum(cs)::BIGINT AS seconds, count(*) AS calls, count(*) FILTER (WHERE value < 10) AS failed_calls FROM u GROUP BY event_type")
def stage_accounting(t):
    return runs.stage_totals(_updates(t), "event_type", "cs", F.col("value") < 10)


@query("""WITH e AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts, event_id) AS us FROM events GROUP BY user_id)
SELECT user_id, len(us)::BIGINT AS chunks, us[1] AS first_us, us[len(us)] AS last_us, CASE WHEN len(us) >= 64 THEN us[64] - us[1] END AS first_64_us,
  CASE WHEN len(us) >= 64 THEN us[len(us)] - us[len(us) - 63] END AS last_64_us FROM e""")
def timing_summary(t):
    events = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return answers.timing_summary(events, "user_id", "us", ["event_id"])


@query(f"""WITH b AS (SELECT event_id, user_id, row_number() OVER ({_W}) AS step FROM events), l AS (SELECT *, lag(step // 10) OVER (PARTITION BY user_id ORDER BY step) AS before FROM b)
SELECT event_id, user_id, step FROM l WHERE before IS NULL OR step // 10 > before""")
def bucket_emit(t):
    steps = ordered.positions(t("events"), ["user_id"], list(ORDER)).withColumn("step", F.col("position") + 1)
    return ordered.bucket_changes(steps, ["user_id"], [F.col("step")], "step").select("event_id", "user_id", "step")


@query(f"WITH b AS (SELECT event_id, user_id, row_number() OVER ({_W}) AS step FROM events) SELECT event_id, user_id, step FROM b WHERE step % 15 = 0 OR step IN (4, 8)")
def checkpoint_schedule(t):
    steps = ordered.positions(t("events"), ["user_id"], list(ORDER)).withColumn("step", F.col("position") + 1)
    return steps.where(ordered.scheduled(F.col("step"), 15, (4, 8))).select("event_id", "user_id", "step")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS late, o_orderstatus = 'P' AS cut, o_custkey % 5 = 0 AS cache, o_custkey % 11 = 0 AS count, o_orderpriority LIKE '1%' AS forced, o_totalprice > 150000 AS eos FROM orders)
SELECT o_orderkey, CASE WHEN late THEN 'TIMEOUT' WHEN cut THEN 'CAPTURE_INCOMPLETE' WHEN cache THEN 'PROMPT_OR_CACHE_MISMATCH' WHEN count THEN 'TOKEN_COUNT_MISMATCH'
  WHEN forced AND eos THEN 'PROBE_COMPLETE' WHEN forced THEN 'PROBE_INCOMPLETE' WHEN eos THEN 'COMPLETE' ELSE 'TERMINATION_MISMATCH' END AS status FROM r""")
def response_status(t):
    c = F.col
    status = answers.response_status(
        late=c("o_orderkey") % 7 == 0, stopped=c("o_orderstatus") != "P", prompt_agrees=c("o_custkey") % 5 != 0, count_agrees=c("o_custkey") % 11 != 0,
        forced=c("o_orderpriority").startswith("1"), at_limit=c("o_totalprice") > 150000, at_end=c("o_totalprice") > 150000,
    )
    return t("orders").select("o_orderkey", status.alias("status"))


@query(f"SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 12")
def tail_n(t):
    return ordered.tail(t("events").select("event_id", "user_id", "ts"), ["user_id"], list(ORDER), 12).select("event_id", "user_id")


@query("""WITH p AS (SELECT a.vec_id, list_transform(generate_series(1, len(a.embedding)), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS d,
  list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE) AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_max(list_transform(d, lambda x: abs(x))), 6) AS max_abs, round(sqrt(list_sum(list_transform(d, lambda x: x * x))) / greatest(sqrt(list_sum(q)), 1e-30), 5) AS relative FROM p""")
def relative_l2(t):
    e = t("embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    m = answers.vector_error(F.col("embedding"), F.col("other"))
    return pairs.select("vec_id", F.round(m["max_abs"], 6).alias("max_abs"), F.round(m["relative"], 5).alias("relative"))


@query(f"""WITH r AS (SELECT event_id, user_id, event_id AS a, event_id + CAST(floor(value) AS BIGINT) AS b FROM events)
SELECT x.event_id, x.user_id FROM r x WHERE EXISTS (SELECT 1 FROM r y WHERE y.user_id = x.user_id AND (y.a < x.a OR (y.a = x.a AND y.event_id < x.event_id)) AND y.b > x.a)""")
def interval_overlap(t):
    ranges = t("events").select("event_id", "user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value").cast("long")).alias("b"))
    return ordered.overlaps(ranges, ["user_id"], "a", "b", [F.col("a"), F.col("event_id")]).select("event_id", "user_id")


_RANGES = "r AS (SELECT DISTINCT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem)"


def _ranges(t):
    return t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).alias("b")).distinct()


@query(f"""WITH {_RANGES}, g AS (SELECT l_orderkey, coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, a AS gap_end FROM r
  UNION ALL SELECT l_orderkey, max(b), 150 FROM r GROUP BY l_orderkey)
SELECT l_orderkey, gap_start::BIGINT AS gap_start, gap_end::BIGINT AS gap_end FROM g WHERE gap_start < gap_end""")
def omitted_gaps(t):
    return ordered.gaps(_ranges(t).withColumn("total", F.lit(150).cast("long")), ["l_orderkey"], "a", "b", "total")


@query(f"""WITH {_RANGES}, p AS (SELECT l_orderkey, list({{'a': a, 'b': b}} ORDER BY a, b) AS s FROM r GROUP BY l_orderkey),
i AS (SELECT *, list_filter(s, lambda x: x.a >= 20 AND x.a < x.b AND x.b <= 70) AS n FROM p), k AS (
  SELECT l_orderkey::VARCHAR AS packet_id, len(list_filter(s, lambda x: NOT (x.a >= 0 AND x.a < x.b AND x.b <= 100))) > 0 AS bad_spans,
    len(list_filter(generate_series(1, len(s) - 1), lambda j: s[j].b > s[j + 1].a)) > 0 AS bad_order,
    NOT (len(n) > 0 AND coalesce(n[1].a = 20, false) AND coalesce(n[len(n)].b = 70, false) AND len(list_filter(generate_series(1, len(n) - 1), lambda j: n[j].b <> n[j + 1].a)) = 0) AS bad_target,
    l_orderkey % 5 = 0 AS bad_kind FROM i)
SELECT packet_id, 'spans' AS rule FROM k WHERE bad_spans UNION ALL SELECT packet_id, 'order' FROM k WHERE bad_order UNION ALL SELECT packet_id, 'target' FROM k WHERE bad_target
UNION ALL SELECT packet_id, 'partition' FROM k WHERE bad_kind""")
def target_containment(t):
    """The ranges of each order as a selection with a target of 20 to 70 in a source of 100 bytes."""
    spans = F.array_sort(F.collect_list(F.struct("a", "b", F.lit("text").alias("kind"))))
    s = _ranges(t).groupBy("l_orderkey").agg(spans.alias("spans")).select(
        F.col("l_orderkey").cast("string").alias("packet_id"), F.lit("a/b").alias("source_path"), F.lit("h").alias("source_sha256"), F.lit("h").alias("sha256"), F.lit(100).cast("long").alias("length"),
        F.when(F.col("l_orderkey") % 5 == 0, "odd").otherwise("training").alias("split"), F.lit("yes").alias("boundary_review"), F.lit("me").alias("reviewer"), "spans",
        F.struct(F.lit(20).cast("long").alias("a"), F.lit(70).cast("long").alias("b")).alias("target"),
    )
    return rules.violations(s, "packet_id", packets.selection_rules()).select(F.col("entity_id").alias("packet_id"), F.col("rule_id").alias("rule"))


@query(f"""WITH {_UPDATES}, c AS (SELECT event_id, user_id, sum(cs) OVER ({_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS charged FROM u) SELECT event_id, user_id, charged, charged > 100000 AS over_budget FROM c""")
def budget_charges(t):
    return ordered.charges(_updates(t), ["user_id"], list(ORDER), F.col("cs"), 100000).select("event_id", "user_id", "charged", "over_budget")


@query("""WITH u AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id END AS step, event_id % 97 AS n, event_id % 101 AS s, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE ELSE value - 1 END AS sec,
  CASE event_type WHEN 'click' THEN 'host_wall' WHEN 'view' THEN 'device_events' WHEN 'error' THEN 'guess' ELSE 'synchronized_wall' END AS timing FROM events)
SELECT event_id::VARCHAR AS entity_id, 'count_global_step' AS rule_id FROM u WHERE step IS NULL UNION ALL SELECT event_id::VARCHAR, 'supervised' FROM u WHERE s > n
UNION ALL SELECT event_id::VARCHAR, 'seconds' FROM u WHERE isnan(sec) OR sec < 0 UNION ALL SELECT event_id::VARCHAR, 'timing' FROM u WHERE timing = 'guess'""")
def telemetry_validity(t):
    """Events as updates, some of them spoilt: every rule that one breaks."""
    c = F.col
    timing = F.when(c("event_type") == "click", "host_wall").when(c("event_type") == "view", "device_events").when(c("event_type") == "error", "guess").otherwise("synchronized_wall")
    updates = t("events").select(
        "event_id", F.when(c("event_id") % 11 != 0, c("event_id")).alias("global_step"), c("event_id").alias("sample_position"), (c("event_id") % 97).alias("nonpadding_tokens"), (c("event_id") % 101).alias("supervised_tokens"),
        F.when(c("event_id") % 13 == 0, float("nan")).otherwise(c("value") - 1).alias("full_loop_seconds"), F.lit(None).cast("double").alias("compute_seconds"), timing.alias("compute_timing"),
    )
    return rules.violations(updates, "event_id", runs.update_rules()).select("entity_id", "rule_id")


_STATES = "CASE event_type WHEN 'view' THEN 'READY' WHEN 'click' THEN 'UPDATING' WHEN 'signup' THEN 'BOUNDARY' WHEN 'purchase' THEN 'CLEAN_STOP' ELSE 'TRAINED' END"


def _journal(t):
    return t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("position"), F.expr(_STATES).alias("status"), F.floor("value").cast("long").alias("completed"))


@query(f"WITH j AS (SELECT user_id AS run, max_by({_STATES}, event_id) AS status FROM events GROUP BY user_id) SELECT run, status, status = 'CLEAN_STOP' AS may_resume FROM j")
def last_states(t):
    return runs.journal_states(_journal(t))


@query(f"""WITH j AS (SELECT user_id AS run, event_id AS position, {_STATES} AS status, floor(value) AS completed, lag({_STATES}) OVER w AS was, lag(floor(value)) OVER w AS had FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT * FROM (VALUES ('READY', 'UPDATING'), ('READY', 'CLEAN_STOP'), ('UPDATING', 'BOUNDARY'), ('BOUNDARY', 'UPDATING'), ('BOUNDARY', 'CLEAN_STOP'), ('BOUNDARY', 'TRAINED'), ('CLEAN_STOP', 'READY')) v(was, status))
SELECT run, position, 'not_begun' AS rule FROM j WHERE was IS NULL AND status <> 'READY'
UNION ALL SELECT run, position, 'transition' FROM j WHERE was IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.was = j.was AND f.status = j.status)
UNION ALL SELECT run, position, 'fell_back' FROM j WHERE completed < had""")
def journal_transitions(t):
    return runs.journal_problems(_journal(t))


@query("""WITH r AS (SELECT conv_id, turn, role FROM conversations), e AS (SELECT conv_id, max(turn) AS active, CASE conv_id % 4 WHEN 0 THEN 'TIME_LIMIT' WHEN 1 THEN 'USER_STOP' WHEN 2 THEN 'CRASH' END AS reason FROM conversations GROUP BY conv_id)
SELECT r.conv_id, turn, CASE WHEN role = 'assistant' THEN 'COMPLETE' WHEN turn = active AND reason = 'TIME_LIMIT' THEN 'TIMEOUT' WHEN turn = active AND reason = 'CRASH' THEN 'FAILED' ELSE 'PENDING' END AS status
FROM r JOIN e USING (conv_id)""")
def failure_attribution(t):
    """Turns as requests, those of the assistant as answered ones; sessions end at their last turn."""
    turns = t("conversations")
    ends = turns.groupBy(F.col("conv_id").alias("session")).agg(F.max("turn").alias("active_index"))
    reason = F.when(F.col("session") % 4 == 0, "TIME_LIMIT").when(F.col("session") % 4 == 1, "USER_STOP").when(F.col("session") % 4 == 2, "CRASH")
    requests = turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("index"))
    captured = turns.where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("index"), F.lit("COMPLETE").alias("status"))
    found = runs.attributed(requests, captured, ends.withColumn("reason", reason))
    return found.select(F.col("session").alias("conv_id"), F.col("index").alias("turn"), "status")


@query("""WITH s AS (SELECT conv_id, count(*) AS requests, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY conv_id)
SELECT conv_id, requests, answers, requests - answers AS pending, 0::BIGINT AS failed FROM s""")
def session_progress(t):
    """Answers of each session by the status that its requests get."""
    turns = t("conversations")
    requests = turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("index"))
    captured = turns.where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("index"), F.lit("COMPLETE").alias("status"))
    ends = turns.select(F.col("conv_id").alias("session")).distinct().select("session", F.lit(0).alias("active_index"), F.lit("USER_STOP").alias("reason"))
    s = runs.attributed(requests, captured, ends).groupBy(F.col("session").alias("conv_id"))
    is_ = lambda x: F.count_if(F.col("status") == x)
    return s.agg(F.count("*").alias("requests"), is_("COMPLETE").alias("answers"), is_("PENDING").alias("pending"), answers.failures(F.when(F.col("status") == "PENDING", "COMPLETE").otherwise(F.col("status"))).alias("failed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, c_nationkey, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def publication_chain(t):
    """Lines, their orders, customers and nations, each bound to the next by its key."""
    key = lambda df, *c: df.select(*c)
    found = runs.chain([
        (key(t("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "", "l_orderkey"), (key(t("orders"), "o_orderkey", "o_custkey"), "o_orderkey", "o_custkey"),
        (key(t("customer"), "c_custkey", "c_nationkey"), "c_custkey", "c_nationkey"), (key(t("nation"), "n_nationkey", "n_name"), "n_nationkey", "n_name"),
    ])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "c_nationkey", "n_name")


@query("""SELECT 'labels' AS record, doc_id::VARCHAR AS key, 'unused' AS rule FROM (SELECT DISTINCT doc_id FROM labels) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'documents', d.doc_id::VARCHAR, 'unbound' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'pages', k::VARCHAR, 'unbound' FROM (SELECT DISTINCT page_id * 2 AS k FROM pages) p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = k) UNION ALL SELECT 'documents', doc_id::VARCHAR, 'unused' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id * 2 = d.doc_id)""")
def publication_breaks(t):
    """Labels, documents bound to them, and pages bound to every second document: what is unbound, and what nothing needs."""
    pages = t("pages").select((F.col("page_id") * 2).alias("document"))
    return runs.chain_problems([("labels", t("labels"), "", "doc_id"), ("documents", t("documents"), "doc_id", "doc_id"), ("pages", pages, "document", "document")])


@query("""WITH a AS (SELECT lang, quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL), b AS (SELECT lang, toxic AS quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT *, 'before' AS side, 1::BIGINT AS copies FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'after', 1 FROM (FROM b EXCEPT FROM a)""")
def state_diff(t):
    """Rows by which two aggregated states of all labelled documents differ, as multisets."""
    both = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id")
    count = lambda x: both.groupBy("lang", F.col(x).alias("quality")).agg(F.count("*").alias("size"))
    return runs.table_diff(count("quality"), count("toxic")).select("lang", "quality", F.col("size").alias("n"), "side", F.col("n").alias("copies"))


@query(f"""WITH f AS (SELECT *, value < 20 AS low, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER ({_W}) AS island,
  epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us FROM events),
c AS (SELECT event_id, us, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS below FROM f)
SELECT event_id, CASE WHEN below >= 3 THEN 'HOST_MEMORY_LIMIT' WHEN us >= 2400000000000 THEN 'PHASE_TIMEOUT' WHEN us >= 1200000000000 THEN 'AGGREGATE_TIMEOUT' END AS reason FROM c""")
def limit_reasons(t):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t("events").withColumn("us", us - F.min(us).over(Window.partitionBy("user_id")))
    counted = ordered.runs_below(e, ["user_id"], list(ORDER), F.col("value") < 20, 3)
    return counted.select("event_id", runs.limit_reason(F.col("below_count"), F.col("us"), F.col("us"), samples=3, phase_limit=2.4e12, total_limit=1.2e12).alias("reason"))


@query("""WITH a AS (SELECT user_id, map_from_entries(list({'key': event_type, 'value': c})) AS m FROM (SELECT user_id, event_type, count(*)::VARCHAR AS c FROM events WHERE event_id % 2 = 0 GROUP BY ALL) GROUP BY user_id),
b AS (SELECT user_id, map_from_entries(list({'key': event_type, 'value': c})) AS m FROM (SELECT user_id, event_type, count(*)::VARCHAR AS c FROM events WHERE event_id % 2 = 1 GROUP BY ALL) GROUP BY user_id),
k AS (SELECT a.user_id, list_filter(map_keys(a.m), lambda x: list_contains(map_keys(b.m), x) AND a.m[x] <> b.m[x]) AS changed,
  list_has_all(map_keys(a.m), map_keys(b.m)) AND list_has_all(map_keys(b.m), map_keys(a.m)) AS whole FROM a JOIN b ON a.user_id = b.user_id)
SELECT user_id, CASE WHEN len(changed) > 0 THEN 'CHANGED' WHEN NOT whole THEN 'UNVERIFIED' ELSE 'MATCH' END AS state, array_to_string(list_sort(changed), ',') AS changed FROM k""")
def runtime_identity(t):
    def side(k, name):
        n = t("events").where(f"event_id % 2 = {k}").groupBy("user_id", "event_type").agg(F.count("*").cast("string").alias("c"))
        return n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias(name))

    state, changed = runs.identity_state(F.col("a"), F.col("b"))
    return side(0, "a").join(side(1, "b"), "user_id").select("user_id", state.alias("state"), F.array_join(changed, ",").alias("changed"))


@query("""WITH p AS (SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 WHEN 'user' THEN 3 END AS place FROM conversations),
b AS (SELECT *, lag(place) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM p) SELECT conv_id, turn, role FROM b WHERE place IS NULL OR before >= place""")
def order_preserved(t):
    """Turns whose role does not stand after the last one's in a reference order."""
    turns = t("conversations").select("conv_id", "turn", "role")
    reference = turns.sparkSession.createDataFrame([("assistant", 1), ("system", 2), ("user", 3)], "role string, place int")
    return runs.out_of_order(turns, ["conv_id"], ["turn"], reference, "role", "place").select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, lag(sha256(text)) OVER w AS before, sha256(text) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY row_number() OVER w > 1 AND lag(sha256(text)) OVER w <> sha256(text)""")
def change_log(t):
    return runs.change_log(t("conversations").withColumn("h", F.sha2("text", 256)), ["conv_id"], "turn", "h")


@query("""SELECT user_id AS execution_id, coalesce(max(CASE WHEN event_type <> 'view' THEN event_id END), max(CASE WHEN event_type = 'view' THEN event_id END)) AS charged,
  count(*) FILTER (WHERE event_type <> 'view') = 0 AS abandoned, count(*) FILTER (WHERE event_type <> 'view') > 1 AS settled_twice FROM events GROUP BY user_id""")
def settled_charges(t):
    ledger = t("events").select(F.col("user_id").alias("execution_id"), F.when(F.col("event_type") == "view", "STARTED").otherwise("COMPLETE").alias("status"), F.col("event_id").alias("elapsed_seconds"))
    return runs.settled_charges(ledger)
