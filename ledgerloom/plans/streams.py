"""Streaming queries: the tables as streams, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import event_streams as sources
from ..sources.scratch import shared
from ..streaming import attempts, events
from .audit import ORACLES, QUERIES


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table as a stream; a table that is one file is read from its folder."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, kept as keyed state over the event stream."""
    rows = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("counter"), F.col("event_type").alias("value"))
    at = shared(spark, "state")
    events.run_to_end(events.keyed_state(rows), events.append_to(f"{at}/rows"), f"{at}/checkpoint")
    found = events.committed(spark, f"{at}/rows")
    return found.groupBy("key").agg(F.max_by(F.struct("counter", "value", "seen"), "seen").alias("x")).select(F.col("key").alias("user_id"), F.col("x.counter").alias("last_id"), F.col("x.value").alias("state"), F.col("x.seen").alias("seen"))


def stream_idempotent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns committed by key as they stream in; of a key's values the first stays."""
    turns = _stream(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.sha2("text", 256).alias("value"))
    at = shared(spark, "merge")
    events.run_to_end(turns, events.append_to(f"{at}/rows"), f"{at}/checkpoint", "append")
    return events.settled(events.committed(spark, f"{at}/rows"), "key", "value")


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each user's stream, appended as they come in, each with its own time of arrival."""
    chunks = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("position"), F.col("props").alias("chunk"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrived"))
    at = shared(spark, "chunks")
    events.run_to_end(chunks, events.append_to(f"{at}/rows"), f"{at}/checkpoint", "append")
    found = events.committed(spark, f"{at}/rows")
    return found.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("chunks"), F.sum(F.octet_length("chunk")).alias("bytes"), F.min("arrived").alias("first_us"), F.max("arrived").alias("last_us"))


def stream_server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen files of server-sent events, written from the table and read as a stream of complete lines.

    A file is split between tasks, and a line over 16 bytes or beyond the file's first 20,000 is told as too long."""
    line = F.when(F.col("event_type") == "error", ": ping").otherwise(F.concat(F.lit("data: "), "props"))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 16).alias("stream"), "event_id", line.alias("line"))
    at = shared(spark, "server-events")
    lines.repartition("stream").sortWithinPartitions("stream", "event_id").select("stream", "line").write.partitionBy("stream").text(f"{at}/files")
    sources.register(spark)
    read = spark.readStream.format("event_lines").option("lineLimit", 16).option("streamLimit", 20_000).option("stretch", 16_384).load(f"{at}/files")
    found = read.select(F.regexp_extract("path", "/stream=([0-9]+)/", 1).cast("long").alias("stream"), "stop", F.try_parse_json(sources.payload()).alias("event"), "too_long").where("too_long or event is not null")
    told = found.select("stream", "stop", F.try_variant_get("event", "$.k", "long").alias("k"), "too_long")
    events.run_to_end(told, events.append_to(f"{at}/rows"), f"{at}/checkpoint", "append")
    return events.committed(spark, f"{at}/rows").select("stream", "stop", "k", "too_long")


def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of training attempts, one a user: counters that fall behind, unknown kinds, losses and memory."""
    kind = F.col("event_type")
    step = F.expr("event_id div 10 - CASE WHEN event_id % 5 = 0 THEN 200 ELSE 0 END")
    cents = F.round(F.col("value") * 100).cast("long")
    rows = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("attempt"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("counter"),
        F.when(kind == "click", "update").when(kind == "purchase", "memory").when(kind == "view", "phase").when(kind == "signup", "attempt").otherwise("guess").alias("kind"),
        step.alias("step"), (step * 4).alias("position"), F.lit(1 << 40).alias("planned"), cents.alias("loss"), (F.col("event_id") % 3 + 1).alias("examples"), cents.alias("memory"),
        F.when(F.col("event_id") % 2 == 0, "training").otherwise("saving").alias("phase"), F.lit("COMPLETE").alias("status"),
    )
    at = shared(spark, "attempts")
    with attempts.large_state(spark):
        events.run_to_end(attempts.attempt_state(rows), events.append_to(f"{at}/rows"), f"{at}/checkpoint")
    return attempts.newest(events.committed(spark, f"{at}/rows")).drop("silent", "batch")


QUERIES["stream_attempts"] = stream_attempts
ORACLES["stream_attempts"] = """
WITH e AS (SELECT user_id AS attempt, event_id, event_type, event_id // 10 - CASE WHEN event_id % 5 = 0 THEN 200 ELSE 0 END AS step, round(value * 100)::BIGINT AS cents, event_id % 3 + 1 AS examples FROM events),
v AS (SELECT *, event_type = 'click' AND step >= 0 AS valid FROM e),
a AS (SELECT *, valid AND step >= coalesce(max(CASE WHEN valid THEN step END) OVER (PARTITION BY attempt ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM v),
r AS (SELECT attempt, cents, examples, row_number() OVER (PARTITION BY attempt ORDER BY event_id DESC) AS n FROM a WHERE taken),
l AS (SELECT attempt, sum(cents * examples)::BIGINT AS loss_12, sum(examples)::BIGINT AS examples_12 FROM r WHERE n <= 12 GROUP BY attempt),
s AS (SELECT attempt, count(*) AS seen, count(*) FILTER (taken) AS updates, count(*) FILTER (event_type = 'error' OR (event_type = 'click' AND NOT taken)) AS ignored, max(step) FILTER (taken) AS step, max(step * 4) FILTER (taken) AS position,
  arg_max(cents, event_id) FILTER (taken) AS loss, arg_max(cents, event_id) FILTER (event_type = 'purchase') AS memory, arg_max(CASE WHEN event_id % 2 = 0 THEN 'training' ELSE 'saving' END, event_id) FILTER (event_type = 'view') AS phase,
  CASE WHEN bool_or(event_type = 'signup') THEN 'COMPLETE' END AS status FROM a GROUP BY attempt)
SELECT s.*, coalesce(loss_12, 0) AS loss_12, coalesce(examples_12, 0) AS examples_12 FROM s LEFT JOIN l USING (attempt)"""


def stream_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream, a durable sink and a display: eight files come one a trigger, of which the display shows 128 lines at most."""
    at = shared(spark, "display")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", (F.col("event_id") % 8).alias("part"))
    rows.repartitionByRange(8, "part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{at}/files")
    read = spark.readStream.schema("event_id long, event_type string, part int").option("maxFilesPerTrigger", 1).parquet(f"{at}/files")
    events.run_to_end(read, events.durable_and_shown(f"{at}/kept", f"{at}/shown", ["event_id"], 128), f"{at}/checkpoint", "append")
    kept = events.committed(spark, f"{at}/kept").agg(F.count("*").alias("kept"), F.sum("event_id").alias("kept_ids"))
    shown = events.committed(spark, f"{at}/shown").agg(F.sum("shown").alias("shown"), F.sum("dropped").alias("dropped"), F.sum(F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["event_id"])).alias("shown_ids"))
    return kept.join(F.broadcast(shown), how="cross")


QUERIES["stream_display"] = stream_display
ORACLES["stream_display"] = """
WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS n FROM events)
SELECT count(*) AS kept, sum(event_id)::BIGINT AS kept_ids, count(*) FILTER (n <= 128) AS shown, count(*) FILTER (n > 128) AS dropped, (sum(event_id) FILTER (n <= 128))::BIGINT AS shown_ids FROM r"""
QUERIES["stream_server_events"] = stream_server_events
ORACLES["stream_server_events"] = """
WITH l AS (SELECT user_id % 16 AS stream, event_id, CASE event_type WHEN 'error' THEN ': ping' ELSE 'data: ' || props END AS line FROM events),
s AS (SELECT *, octet_length(encode(line)) AS size, (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY stream ORDER BY event_id))::BIGINT AS stop FROM l)
SELECT stream, stop, CASE WHEN size <= 16 AND line LIKE 'data: %' THEN (substr(line, 7) ->> '$.k')::BIGINT END AS k, size > 16 OR stop > 20000 AS too_long FROM s WHERE size > 16 OR stop > 20000 OR line LIKE 'data: %'"""
QUERIES["stream_chunks"] = stream_chunks
ORACLES["stream_chunks"] = "SELECT user_id, count(*) AS chunks, sum(octet_length(encode(props)))::BIGINT AS bytes, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id"
QUERIES["stream_state"] = stream_state
QUERIES["stream_idempotent_merge"] = stream_idempotent_merge
ORACLES["stream_state"] = "SELECT user_id, max(event_id) AS last_id, max_by(event_type, event_id) AS state, count(*) AS seen FROM events GROUP BY user_id"
ORACLES["stream_idempotent_merge"] = "SELECT conv_id || ':' || turn AS key, min(sha256(text)) AS value, count(DISTINCT text) - 1 AS conflicts FROM conversations GROUP BY conv_id, turn"
