"""Ledgers of fetches, histories of training and control files over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fetches, histories
from ..sources import sinks
from ..sources.scratch import forget, shared
from .audit import query

c = F.col

_FETCHES = """e AS (
  SELECT user_id % 4 AS ledger, event_id AS position, epoch_us(ts) AS moment, CASE WHEN event_id % 3 = 0 THEN 'index' ELSE 'filing' END AS kind,
    CASE event_type WHEN 'view' THEN 'complete' WHEN 'click' THEN 'http_error' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'empty' ELSE 'odd' END AS status,
    CASE WHEN event_id % 997 = 0 THEN 429 WHEN event_type = 'click' THEN 404 ELSE 200 END AS http_status, CASE WHEN event_id % 1009 = 0 THEN '60' END AS retry_after,
    (value * 100)::BIGINT AS bytes, 'u' || (event_id % 500) AS url, CASE WHEN event_type = 'view' THEN sha256(props) ELSE 'none' END AS sha FROM events),
b AS (SELECT *, http_status IN (403, 429) OR retry_after IS NOT NULL AS blocks, kind = 'filing' AND http_status = 200 AND bytes > 0 AS filed FROM e),
r AS (SELECT *, lag(moment) OVER w AS earlier, max(blocks::INT) OVER p AS closed, sum(bytes) OVER p AS held, sum(filed::INT) OVER p AS filings, count(*) OVER (PARTITION BY ledger ORDER BY moment RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS near,
  row_number() OVER (PARTITION BY ledger, url, status = 'complete' ORDER BY position) AS nth
  FROM b WINDOW w AS (PARTITION BY ledger ORDER BY position), p AS (PARTITION BY ledger ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_FETCHES}, x AS (SELECT ledger, position, unnest([CASE WHEN status = 'odd' THEN 'unknown_status' END, CASE WHEN moment - earlier < 2000000 THEN 'too_soon' END, CASE WHEN near > 3 THEN 'too_many' END, CASE WHEN closed = 1 THEN 'after_block' END,
  CASE WHEN held >= 5000000 THEN 'over_bytes' END, CASE WHEN kind = 'filing' AND filings >= 900 THEN 'over_filings' END, CASE WHEN blocks AND status <> 'blocked' THEN 'block_not_told' END,
  CASE WHEN status = 'complete' AND NOT (http_status = 200 AND regexp_matches(sha, '^[0-9a-f]{{64}}$')) THEN 'not_complete' END, CASE WHEN status = 'complete' AND nth > 1 THEN 'fetched_again' END]) AS rule FROM r)
SELECT * FROM x WHERE rule IS NOT NULL""")
def fetch_ledger(t):
    """Events as four ledgers of requests: those too soon, too many within ten minutes, after a block, or over a ceiling."""
    kind, n = c("event_type"), c("event_id")
    cents = F.round(c("value") * 100)
    ledger = t("events").select(
        (c("user_id") % 4).alias("ledger"), n.alias("position"), F.unix_micros(c("ts").cast("timestamp")).alias("at"), F.when(n % 3 == 0, "index").otherwise("filing").alias("kind"),
        F.when(kind.isin("view", "purchase"), "complete").when(kind == "click", "http_error").when(kind == "signup", "empty").otherwise("odd").alias("status"),
        F.when(n % 997 == 0, 429).when(kind == "click", 404).otherwise(200).alias("http_status"), F.when(n % 1009 == 0, "60").alias("retry_after"), cents.cast("long").alias("bytes"),
        F.concat(F.lit("u"), n % 500).alias("url"), F.lit("o").alias("output"), F.when(kind == "view", F.sha2("props", 256)).otherwise("none").alias("sha256"),
    )
    return fetches.fetch_problems(ledger, pause=2_000_000, window=600_000_000, most=3, max_bytes=5_000_000, max_filings=900)


_HISTORY = """t AS (SELECT conv_id AS run, turn AS place, sha256(conv_id || ':' || turn || ':' || text) AS hash, length(text) AS size FROM conversations),
l AS (SELECT *, lag(hash) OVER (PARTITION BY run ORDER BY place) AS before, row_number() OVER (PARTITION BY run ORDER BY place) AS n FROM t),
h AS (SELECT run, hash, CASE WHEN run % 7 = 0 AND n = 4 THEN 'gone' ELSE before END AS parent, NOT (run % 5 = 0 AND n = 3) AS sound FROM l
  UNION ALL SELECT run, 'fork' || hash, before, size % 2 = 0 FROM l WHERE n = 3)"""


@query(f"""WITH RECURSIVE {_HISTORY}, d AS (SELECT run, hash, 1::BIGINT AS depth FROM h WHERE parent IS NULL AND sound UNION ALL SELECT h.run, h.hash, d.depth + 1 FROM d JOIN h ON h.run = d.run AND h.parent = d.hash WHERE h.sound),
m AS (SELECT run, max(depth) AS depth FROM d GROUP BY run), e AS (SELECT d.run, min(hash) AS hash, m.depth, (SELECT count(*) FROM d x WHERE x.run = d.run) AS reached FROM d JOIN m ON m.run = d.run AND m.depth = d.depth GROUP BY d.run, m.depth),
n AS (SELECT run, count(*) AS rows FROM h GROUP BY run)
SELECT n.run, e.hash, coalesce(e.depth, 0)::BIGINT AS depth, n.rows, n.rows - coalesce(reached, 0) AS cut_off FROM n LEFT JOIN e ON e.run = n.run""")
def history_resume_points(t):
    """Turns as histories chained by hashes, with forks, broken links and unsound rows: where each run may resume."""
    from ..operators.ordered import adjacent, positions

    rows = t("conversations").select(c("conv_id").alias("run"), c("turn").alias("place"), F.sha2(F.concat_ws(":", "conv_id", "turn", "text"), 256).alias("hash"), F.length("text").alias("size"))
    told = positions(adjacent(rows, ["run"], ["place"], ["hash"]), ["run"], ["place"])
    third = told.where("position = 2").select("run", F.concat(F.lit("fork"), "hash").alias("hash"), c("before_hash").alias("parent"), (c("size") % 2 == 0).alias("sound"))
    main = told.select("run", "hash", F.when((c("run") % 7 == 0) & (c("position") == 3), "gone").otherwise(c("before_hash")).alias("parent"), (~((c("run") % 5 == 0) & (c("position") == 2))).alias("sound"))
    return histories.resume_points(histories.chained(main.unionByName(third)))


@query("""WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n FROM documents), k AS (SELECT *, n % 11 AS m FROM d)
SELECT lang AS run, doc_id AS position, 'step' AS rule FROM k WHERE m = 1 UNION ALL SELECT lang, doc_id, 'tokens' FROM k WHERE m IN (2, 3) UNION ALL SELECT lang, doc_id, 'measurement' FROM k WHERE m IN (3, 4, 5)""")
def history_faults(t):
    """Documents as rows of histories, a language a run, spoilt in five ways."""
    from ..operators.ordered import positions

    rows = positions(t("documents").select(c("lang").alias("run"), c("doc_id").alias("place")), ["run"], ["place"]).withColumn("m", c("position") % 11)
    spoilt = rows.select(
        "run", c("place").alias("position"), F.when(c("m") == 1, None).otherwise(c("position") + 1).alias("step"), F.when(c("m").isin(2, 3), 0).otherwise(5).alias("response_tokens"),
        F.when(c("m").isin(3, 4), float("nan")).otherwise(0.5).alias("loss"), F.when(c("m") == 5, -1.0).otherwise(2.0).alias("update_seconds"),
    )
    return histories.history_problems(spoilt)


@query("SELECT 3::BIGINT AS version, count(*) AS targets, count(*) FILTER (WHERE lang = 'en') AS english FROM documents")
def control_versions(t):
    """A report written three times as versions of a control file, after which a fourth is left unfinished; the newest complete one is read."""
    docs = t("documents")
    spark = docs.sparkSession
    at = shared(spark, "control")
    report = docs.agg(F.count("*").alias("targets"), F.count_if(c("lang") == "en").alias("english"))
    for _ in range(3):
        sinks.write_report(report, at)
    sinks.Folder(spark, at).put("v000000000004", "0" * 64 + '\\n{"targets"')
    number, text = sinks.newest_version(spark, at)
    forget(spark, at)
    told = spark.range(1).select(F.lit(number).cast("long").alias("version"), F.from_json(F.lit(text), "targets long, english long").alias("r"))
    return told.select("version", "r.targets", "r.english")
