"""State of training attempts over a stream of their events: what an attempt was last, and a timer for silence."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "attempt long, at timestamp, counter long, kind string, step long, position long, planned long, loss long, examples long, memory long, phase string, status string"
_NOW = "seen long, updates long, ignored long, step long, position long, loss long, memory long, phase string, status string, expires long, losses array<long>, examples array<long>"
OUT = "attempt long, seen long, updates long, ignored long, step long, position long, loss long, memory long, phase string, status string, loss_12 long, examples_12 long, silent boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

# What an event may change. An update that has no loss, or none to be weighed, and a memory that is unknown are kinds of their own.
_IGNORED, _WEIGHED, _UNWEIGHED, _UPDATE, _MEMORY, _NO_MEMORY, _PHASE, _STATUS = range(8)
_COLUMNS = pd.Index([c.split()[0] for c in OUT.split(", ")])


def _told(key: tuple, now: tuple, silent: bool) -> pd.DataFrame:
    *facts, _, losses, examples = now
    row = np.empty((1, len(_COLUMNS)), dtype=object)
    row[0] = (None if pd.isna(key[0]) else int(key[0]), *facts, sum(x * n for x, n in zip(losses, examples)), sum(examples), silent)
    return pd.DataFrame(row, columns=_COLUMNS)


def attempt(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, silence: int, kept: int) -> Iterator[pd.DataFrame]:
    """Keeps counters, loss, memory, phase and status of an attempt, and its last `kept` losses.

    An update counts if 0 <= step <= planned, planned > 0, and neither step nor position falls behind the last one that counted; its loss only
    counts then. Other updates and unknown kinds are ignored, and counted as such. Events are taken in the order of their
    counters within a trigger. An attempt that is silent for `silence` milliseconds of event time is told once as silent, until it speaks again.
    """
    if state.hasTimedOut:
        now = state.get
        state.update(now)  # written again, without a timer
        yield _told(key, now, True)
        return
    seen, updates, ignored, step, position, loss, memory, phase, status, expires, losses, examples = state.getOption or (0, 0, 0, None, None, None, None, None, None, 0, [], [])
    losses, examples = list(losses), list(examples)
    parts = [(np.stack(rows["numbers"].to_list()), rows["text"].to_numpy()) for rows in batches if len(rows)]
    numbers, texts = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*parts))
    order = numbers[:, 0].argsort(kind="stable")
    seen += len(order)
    expires = max(expires, int(numbers[:, 1].max()) + silence)
    for (kind, at, where, amount, count), text in zip(numbers[order, 2:].tolist(), texts[order]):
        if kind <= _UPDATE:
            if kind == _IGNORED or (step is not None and (at < step or where < position)):
                ignored += 1
                continue
            step, position, loss, updates = at, where, None if kind == _UPDATE else amount, updates + 1
            if kind == _WEIGHED:
                losses.append(amount)
                examples.append(count)
        elif kind == _MEMORY:
            memory = amount
        elif kind == _NO_MEMORY:
            memory = None
        elif kind == _PHASE:
            phase = text
        else:
            status = text
    now = (seen, updates, ignored, step, position, loss, memory, phase, status, expires, losses[-kept:], examples[-kept:])
    state.update(now)
    yield _told(key, now, False)
    if expires < state.getCurrentWatermarkMs():  # the time for its timer is over
        yield _told(key, now, True)
    else:
        state.setTimeoutTimestamp(expires)


def attempt_state(events: DataFrame, silence: int = 600_000, late: str = "1 hour", kept: int = 12) -> DataFrame:
    """Rows of OUT whenever an attempt of a stream (EVENT) has changed or fallen silent.

    A trigger's events of an attempt are held at once to put them in order, so triggers are to be bounded (maxBytesPerTrigger).
    State comes and goes with the rows, thousands of attempts at a time: a store asked by each attempt, over wider rows, took twice as long.
    What a row tells by itself is Spark's work; its numbers travel as one column, as each column of each attempt is a cost of its own."""
    counts = "step BETWEEN 0 AND planned AND planned > 0 AND position IS NOT NULL"
    kind = F.expr(
        f"CASE kind WHEN 'update' THEN CASE WHEN ({counts}) IS NOT TRUE THEN {_IGNORED} WHEN loss IS NULL THEN {_UPDATE} WHEN examples IS NULL THEN {_UNWEIGHED} ELSE {_WEIGHED} END "
        f"WHEN 'memory' THEN nvl2(memory, {_MEMORY}, {_NO_MEMORY}) WHEN 'phase' THEN {_PHASE} WHEN 'attempt' THEN {_STATUS} ELSE {_IGNORED} END"
    )
    number = lambda c, without=0: F.coalesce(c, F.lit(without)).cast("long")
    amount = F.when(F.col("kind") == "memory", F.col("memory")).otherwise(F.col("loss"))
    numbers = F.array(number("counter", (1 << 63) - 1), number(F.unix_millis("at")), kind.cast("long"), number("step"), number("position"), number(amount), number("examples"))
    text = F.when(F.col("kind") == "phase", F.col("phase")).when(F.col("kind") == "attempt", F.col("status"))
    rows = events.withWatermark("at", late).select("attempt", "at", numbers.alias("numbers"), text.alias("text"))
    return rows.groupBy("attempt").applyInPandasWithState(functools.partial(attempt, silence=silence, kept=kept), OUT, _NOW, "update", GroupStateTimeout.EventTimeTimeout)


@contextlib.contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """State of many attempts is kept outside the heap; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def newest(states: DataFrame) -> DataFrame:
    """The last row told of each attempt."""
    return states.where("not silent").groupBy("attempt").agg(F.max_by(F.struct(*[c for c in states.columns if c != "attempt"]), "seen").alias("x")).select("attempt", "x.*")
