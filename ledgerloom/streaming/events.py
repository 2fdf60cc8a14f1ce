"""Structured Streaming: event state, idempotent answer commits, durable appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.canonical import strict_variant

# Kinds and schema of training events.
KINDS = ("phase", "update", "measurement", "memory", "attempt")
EVENT_SCHEMA = "training-event-v1"


#: What a line must be to be an event, each over its variant `v`. A line that keeps all is one.
RULES = (
    "v.schema_version = '%s'" % EVENT_SCHEMA,
    "v.kind IN (%s)" % ", ".join(f"'{k}'" for k in KINDS),
    "v.seconds_type RLIKE '^(BIGINT|DOUBLE|DECIMAL)'",
    "v.seconds >= 0 AND v.seconds < double('Infinity')",
)


def events(lines: Column | str) -> Column:
    """struct(kind, attempt_id, seconds, event) of well-formed events, nulls for other lines: optional telemetry never fails its reader.

    event is the JSON with sorted keys. A line that repeats a key is none."""
    text = F.col(lines) if isinstance(lines, str) else lines
    told = strict_variant(text)
    seconds = F.try_variant_get(told, "$.attempt_elapsed_seconds", "variant")
    of = lambda name, kind: F.try_variant_get(told, f"$.{name}", kind)
    facts = F.struct(of("schema_version", "string").alias("schema_version"), of("kind", "string").alias("kind"), of("attempt_id", "string").alias("attempt_id"), F.schema_of_variant(seconds).alias("seconds_type"), of("attempt_elapsed_seconds", "double").alias("seconds"), F.to_json(told).alias("event"))
    fits = " AND ".join(f"coalesce({r}, false)" for r in RULES)
    return F.get(F.call_function("transform", F.array(facts), F.expr(f"v -> named_struct('kind', IF({fits}, v.kind, null), 'attempt_id', IF({fits}, v.attempt_id, null), 'seconds', IF({fits}, v.seconds, null), 'event', IF({fits}, v.event, null))")), F.lit(0))


def latest(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps for a key the newest row by counter, and how many rows came; lower counters change nothing but the count."""
    counter, value, seen = state.get if state.exists else (-1, None, 0)
    for rows in batches:
        rows = rows.sort_values("counter")
        seen += len(rows)
        if len(rows) and int(rows["counter"].iat[-1]) > counter:
            counter, value = int(rows["counter"].iat[-1]), rows["value"].iat[-1]
    state.update((counter, value, seen))
    yield pd.DataFrame({"key": [keys[0]], "counter": [counter], "value": [value], "seen": [seen]})


STATE = "counter long, value string, seen long"


def keyed_state(stream: DataFrame) -> DataFrame:
    """State by key of a stream (key long, counter long, value string); a row whenever a key changes."""
    return stream.groupBy("key").applyInPandasWithState(latest, f"key long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hands all rows that are there to commit(batch, id), then ends. A restart goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(commit).start().awaitTermination()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A commit that writes each batch to a place of its own: a repeated batch replaces itself."""

    def commit(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return commit


def durable_and_shown(kept: str, shown: str, order: list[str], most: int) -> Callable[[DataFrame, int], None]:
    """A commit to two sinks: `kept` gets every row, the display in `shown` the first `most` of a trigger and the number of those it dropped.

    The display is one row a trigger (lines, shown, dropped) and may lose lines, never the durable sink; both replace themselves when a batch is repeated."""

    def commit(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{kept}/batch={n}")
        rows = batch.sparkSession.read.parquet(f"{kept}/batch={n}")
        first = rows.orderBy(*order).limit(most).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in order]))).alias("lines"))
        total = rows.agg(F.count("*").alias("total"))
        told = first.join(F.broadcast(total), how="cross").select("lines", F.size("lines").cast("long").alias("shown"), (F.col("total") - F.size("lines")).alias("dropped"))
        told.write.mode("overwrite").parquet(f"{shown}/batch={n}")

    return commit


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All batches that append_to() wrote."""
    return spark.read.option("basePath", path).parquet(path)


def settled(rows: DataFrame, key: str, value: str, batch: str = "batch") -> DataFrame:
    """(key, value, conflicts): the first value committed for a key, and how many others came.

    A repeated commit of the same value is none; another value never replaces the first.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(batch, value))[value].alias(value), (F.count_distinct(value) - 1).alias("conflicts"))
    return first
