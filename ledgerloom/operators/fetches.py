"""Ledgers of fetches: what a client that keeps a rate, ceilings and a closed latch would not have done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import Fold, running

#: Microseconds of a stretch of time in which one task counts requests.
STRETCH = 3_600_000_000
# Answers that close a ledger, and how an event may end.
BLOCKING = (403, 429)
STATUSES = ("complete", "blocked", "byte_limit", "http_error", "empty", "transport_error", "started")


def blocked() -> Column:
    """Whether an event closes its ledger: by its status, its answer, or a demand to wait."""
    return F.coalesce(F.col("status") == "blocked", F.lit(False)) | F.coalesce(F.col("http_status").isin(*BLOCKING), F.lit(False)) | (F.coalesce(F.length("retry_after"), F.lit(0)) > 0)


def requests_within(events: DataFrame, ledger: str, at: str, window: int, stretch: int = STRETCH) -> DataFrame:
    """Adds `within`, the requests of the ledger in the last `window` microseconds, the row's own and those of its own moment included.

    A RANGE frame over time. A ledger is cut into stretches of time, so that none is one task's; what lies
    within a window before the next stretch is handed on to it, where it only counts.
    """
    length = max(stretch, window + 1)
    place = F.floor(F.col(at) / length)
    also = F.when(F.pmod(F.col(at), F.lit(length)) >= length - window, F.array(place, place + 1)).otherwise(F.array(place))
    dealt = events.select("*", F.explode(also).alias("_stretch"))
    frame = Window.partitionBy(ledger, "_stretch").orderBy(at).rangeBetween(-window, 0)
    return dealt.withColumn("within", F.count(F.lit(1)).over(frame)).where(F.col("_stretch") == place).drop("_stretch")


def fetch_problems(events: DataFrame, ledger: str = "ledger", order: str = "position", pause: int = 500_000, window: int = 1_000_000, most: int = 2, max_bytes: int = 4 << 30, max_filings: int = 60) -> DataFrame:
    """(ledger, position, rule) of events (at in microseconds, kind, status, http_status, retry_after, bytes, url, output, sha256).

    A request may not come before a pause, nor be one of more than `most` in a window, nor come after one that closed the ledger, nor once the
    bytes or filings before it have reached their ceiling. What the answer says and how the event ended must agree, and what was
    completed is not fetched again. Null sizes are 0. Every rule that is broken is a row; a ledger of any size is scanned in parts.
    """
    c = F.col
    filed = (c("kind") == "filing") & (c("http_status") == 200) & (c("bytes") > 0)
    one = lambda x: F.coalesce(x, F.lit(False)).cast("long")
    folds = {
        "_last": Fold("lag", c("at")), "_closed": Fold("max", one(blocked()), before=True), "_bytes": Fold("sum", F.coalesce(c("bytes"), F.lit(0)).cast("long"), before=True), "_filings": Fold("sum", one(filed), before=True),
    }
    told = requests_within(running(events, [ledger], [order], folds), ledger, "at", window)
    broken = F.array_compact(F.array(
        F.when(~F.coalesce(c("status").isin(*STATUSES), F.lit(False)), "unknown_status"), F.when(c("at") - c("_last") < pause, "too_soon"), F.when(c("within") > most, "too_many"), F.when(c("_closed") == 1, "after_block"),
        F.when(c("_bytes") >= max_bytes, "over_bytes"), F.when((c("kind") == "filing") & (c("_filings") >= max_filings), "over_filings"), F.when(blocked() & (c("status") != "blocked"), "block_not_told"),
        F.when((c("status") == "complete") & ~F.coalesce((c("http_status") == 200) & c("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "not_complete"),
    ))
    each = told.select(ledger, order, F.explode(broken).alias("rule"))
    done = events.where("status = 'complete'")
    first = done.groupBy(ledger, "url", "output").agg(F.min(order).alias("_first"))
    again = done.join(first, [ledger, "url", "output"]).where(c(order) > c("_first")).select(ledger, order, F.lit("fetched_again").alias("rule"))
    return each.unionByName(again)
