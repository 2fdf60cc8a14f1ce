"""Ordered analytics: rolling rates, progress, intervals, islands, schedules.

All run over a key, in an order that the caller makes unique; a key that is too large for one task is scanned in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import Fold, over_last, running


def rolling(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column], n: int = 12) -> DataFrame:
    """Adds running sums over the last n rows, and `updates`, how many those are."""
    if n < 1:
        raise ValueError("a window holds one update or more")
    return over_last(df, keys, order, sums, n)


def rate(amount: Column, seconds: Column) -> Column:
    """Amount a second; null where no second passed."""
    return F.when(seconds != 0, amount / seconds)


def overlaps(df: DataFrame, keys: list[str], start: str, end: str, order: list) -> DataFrame:
    """Rows whose half-open range overlaps an earlier one's; touching ranges don't.

    The largest end so far decides, in one sorted pass, instead of a self join on ranges.
    """
    return running(df, keys, order, {"_reach": Fold("max", F.col(end), before=True)}).where(F.col("_reach") > F.col(start)).drop("_reach")


def gaps(df: DataFrame, keys: list[str], start: str, end: str, total: str) -> DataFrame:
    """(keys, gap_start, gap_end): what ranges leave open between 0 and the key's total."""
    reached = running(df, keys, [F.col(start), F.col(end)], {"_reach": Fold("max", F.col(end), before=True)})
    inner = reached.select(*keys, F.coalesce("_reach", F.lit(0)).alias("gap_start"), F.col(start).alias("gap_end"))
    last = df.groupBy(*keys).agg(F.max(end).alias("gap_start"), F.max(total).alias("gap_end"))
    return inner.unionByName(last).where("gap_start < gap_end")


def not_increasing(df: DataFrame, keys: list[str], order: list, counter: str) -> DataFrame:
    """Rows whose counter does not exceed the one before."""
    return running(df, keys, order, {"previous": Fold("lag", F.col(counter))}).where(F.col("previous") >= F.col(counter))


def periods(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds update_period: first_update for a key's first row, steady_state for later ones."""
    told = running(df, keys, order, {"_n": Fold("count")})
    return told.withColumn("update_period", F.when(F.col("_n") == 1, "first_update").otherwise("steady_state")).drop("_n")


def remaining(df: DataFrame, keys: list[str], order: list, seconds: str, step: str, planned: int) -> DataFrame:
    """Adds later_seconds, later_updates and left: what an estimate of the time left is made of.

    Rows after the first count, or the first where it is alone; `left` updates times the mean is the
    estimate, and there is none where later_seconds is zero.
    """
    told = running(df, keys, order, {"_n": Fold("count"), "_first": Fold("first", F.col(seconds)), "_total": Fold("sum", F.col(seconds))})
    n, first, total = F.col("_n"), F.col("_first"), F.col("_total")
    return told.select(
        *df.columns,
        F.when(n == 1, total).otherwise(total - first).alias("later_seconds"),
        F.greatest(n - 1, F.lit(1)).cast("long").alias("later_updates"),
        F.greatest(F.lit(planned) - F.col(step), F.lit(0)).cast("long").alias("left"),
    )


def epoch(position: Column, bounds: list[int]) -> dict[str, Column]:
    """epoch, done and size at a sample position; a boundary belongs to the epoch it ends."""
    if not bounds or bounds[0] <= 0 or any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("epoch boundaries rise from above zero")
    known, starts = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, [0, *bounds[:-1]]))
    at = F.array_position(F.transform(known, lambda b: b >= position), F.lit(True)).cast("int")
    inside = (position >= 0) & (position <= bounds[-1])
    start = F.get(starts, at - 1)
    return {"epoch": F.when(inside, at), "done": F.when(inside, position - start), "size": F.when(inside, F.get(known, at - 1) - start)}


def runs_below(df: DataFrame, keys: list[str], order: list, below: Column, least: int = 2) -> DataFrame:
    """Adds `below_count`, rows in a row so far for which `below` holds, and `limit` once they are `least`."""
    told = running(df, keys, order, {"_n": Fold("count")})
    high = running(told.withColumn("_high", F.when(F.coalesce(below, F.lit(False)), None).otherwise(F.col("_n"))), keys, order, {"_last": Fold("max", F.col("_high"))})
    counted = high.withColumn("below_count", F.col("_n") - F.coalesce("_last", F.lit(0)))
    return counted.withColumn("limit", F.col("below_count") >= least).drop("_n", "_high", "_last")


def bucket_changes(df: DataFrame, keys: list[str], order: list, value: str, width: int = 10) -> DataFrame:
    """Rows where the value enters another bucket of the width than the row before."""
    bucket = F.floor(F.col(value) / width)
    return running(df, keys, order, {"_before": Fold("lag", bucket)}).where(F.col("_before").isNull() | (bucket > F.col("_before"))).drop("_before")


def scheduled(step: Column, every: int, listed: tuple[int, ...] = ()) -> Column:
    """True on every n-th step and on the listed ones."""
    return (step % every == 0) | step.isin(*listed) if listed else step % every == 0


def tail(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def charges(df: DataFrame, keys: list[str], order: list, amount: Column, budget) -> DataFrame:
    """Adds `charged`, the running sum of reserved and settled amounts, and whether it is over the budget."""
    return running(df, keys, order, {"charged": Fold("sum", amount)}).withColumn("over_budget", F.col("charged") > budget)


def positions(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds `position`, from zero, in each key."""
    return running(df, keys, order, {"position": Fold("count", before=True)})


def extremes(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Adds `least` and `most`, the smallest and largest value of the key so far."""
    return running(df, keys, order, {"least": Fold("min", F.col(value)), "most": Fold("max", F.col(value))})


def shown_counters(df: DataFrame, keys: list[str], order: list, counter: str) -> DataFrame:
    """Adds `shown`, the counter as a display keeps it: a fall is ignored."""
    return running(df, keys, order, {"shown": Fold("max", F.col(counter))})


def adjacent(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Adds before_<column> and after_<column>, those of the neighbours in the key."""
    return running(df, keys, order, {f"{side}_{c}": Fold(how, F.col(c)) for side, how in (("before", "lag"), ("after", "lead")) for c in columns})


def attempt_totals(df: DataFrame, keys: list[str], order: list, sums: list[str], loop: str | None = None) -> DataFrame:
    """(keys, period, updates, sums): totals of all updates, the first one and later ones of each key.

    The first row is found by its order in a partial aggregate, not by sorting the key. `loop` names a column
    whose largest value, if any, takes the place of the first sum over all updates: the loop's own clock.
    """
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*sums), F.struct(*order)).alias("f"), F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums], *([F.max(loop).alias("_loop")] if loop else []))
    clock = F.coalesce("_loop", sums[0]) if loop else F.col(sums[0])
    rows = [
        F.struct(F.lit("all").alias("period"), F.col("_n").alias("updates"), clock.alias(sums[0]), *[F.col(c).alias(c) for c in sums[1:]]),
        F.struct(F.lit("first").alias("period"), F.lit(1).cast("long").alias("updates"), *[F.col(f"f.{c}").alias(c) for c in sums]),
        F.struct(F.lit("later").alias("period"), (F.col("_n") - 1).alias("updates"), *[(F.col(c) - F.col(f"f.{c}")).alias(c) for c in sums]),
    ]
    return first.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
