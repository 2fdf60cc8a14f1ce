"""Running values over ordered keys of any size: a prefix scan for keys that one task should not order alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Rows of a key up to which one task orders it, in a window.
HOT = 1 << 20


@dataclass(frozen=True)
class Fold:
    """A running value of a column.

    how: sum, min, max or count of the rows so far (`before`: without the row itself), first of the rows so far,
    lag or lead, the neighbour's value.
    """

    how: str
    column: Column | None = None
    before: bool = False


def _local(fold: Fold, value: Column, w) -> Column:
    """The running value inside a window."""
    so_far = w.rowsBetween(Window.unboundedPreceding, -1 if fold.before else 0)
    if fold.how in ("lag", "lead"):
        return getattr(F, fold.how)(value).over(w)
    if fold.how == "count":
        return F.count(F.lit(1)).over(so_far)
    return getattr(F, fold.how)(value).over(so_far)


def _whole(fold: Fold, value: str) -> Column:
    """What a part adds to those after it (lead: before it)."""
    match fold.how:
        case "count":
            return F.count("*")
        case "lag":
            return F.max_by(F.struct(value), "_scan_rn")
        case "first" | "lead":
            return F.min_by(F.struct(value), "_scan_rn")
    return getattr(F, fold.how)(value)


def _carried(fold: Fold, whole: str) -> Column:
    """What comes into a part of a key from the others, over one row a part."""
    w = Window.partitionBy("_scan_key").orderBy("_scan_part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    match fold.how:
        case "lag" | "lead":
            return getattr(F, fold.how)(whole).over(w)
        case "first":
            return F.first(whole).over(earlier)
        case "count":
            return F.sum(whole).over(earlier)
    return getattr(F, fold.how)(whole).over(earlier)


def _combined(fold: Fold, local: Column, carry: Column, value: str) -> Column:
    match fold.how:
        case "sum":
            return F.coalesce(carry + local, carry, local)
        case "count":
            return F.coalesce(carry, F.lit(0)) + local
        case "min":
            return F.least(carry, local)
        case "max":
            return F.greatest(carry, local)
        case "first":
            return F.when(carry.isNotNull(), carry[value]).otherwise(local)
        case "lag":
            return F.when(F.col("_scan_rn") == 1, carry[value]).otherwise(local)
    return F.when(F.col("_scan_rn") == F.col("_scan_rows"), carry[value]).otherwise(local)


def running(df: DataFrame, keys: list[str], order: list, folds: dict[str, Fold], hot: int | None = None) -> DataFrame:
    """df with a column for each fold, over the rows of a key in an order that the caller makes unique.

    Where no key has more than `hot` rows (HOT), these are windows over the key. The rows of other keys are
    partitioned by ranges of key and order, so that a key is many tasks' work: each part is folded by itself,
    the folds are scanned over the parts, a row each, and what comes from other parts is added. Sums of floating
    numbers may differ in their last digits, as they are added in another order. Null keys are keys like others.
    """
    hot = HOT if hot is None else hot
    names, key = df.columns, F.struct(*keys)

    def windows(some: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return some.select(*names, *[_local(f, f.column, w).alias(n) for n, f in folds.items()])

    if df.count() <= hot:
        return windows(df)
    counts = cut(df.groupBy(key.alias("_scan_key")).agg(F.count("*").alias("n")).where(F.col("n") > hot))
    rows = counts.agg(F.sum("n")).first()[0]
    if not rows:
        return windows(df)
    # Of keys over `hot` rows there are at most so many as the table has times `hot` rows.
    heavy = F.broadcast(counts.select("_scan_key"))
    keyed = df.withColumn("_scan_key", key)
    rest = windows(keyed.join(heavy, "_scan_key", "left_anti"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows // hot))
    values = {n: f"_scan_v{i}" for i, n in enumerate(folds)}
    told = keyed.join(heavy, "_scan_key", "left_semi").select("*", *[(f.column if f.column is not None else F.lit(1)).alias(values[n]) for n, f in folds.items()])
    placed = told.repartitionByRange(parts, *keys, *order).withColumn("_scan_part", F.spark_partition_id())
    w = Window.partitionBy("_scan_part", "_scan_key").orderBy(*order)
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = cut(placed.select("*", F.row_number().over(w).alias("_scan_rn"), F.count(F.lit(1)).over(all_of).alias("_scan_rows"), *[_local(f, F.col(values[n]), w).alias(f"_l{values[n]}") for n, f in folds.items()]))
    ends = held.groupBy("_scan_part", "_scan_key").agg(*[_whole(f, values[n]).alias(f"_w{values[n]}") for n, f in folds.items()])
    carries = cut(ends.select("_scan_part", "_scan_key", *[_carried(f, f"_w{values[n]}").alias(f"_c{values[n]}") for n, f in folds.items()]))
    both = held.join(F.broadcast(carries) if carries.count() <= HOT else carries, ["_scan_part", "_scan_key"])
    return both.select(*names, *[_combined(f, F.col(f"_l{values[n]}"), F.col(f"_c{values[n]}"), values[n]).alias(n) for n, f in folds.items()]).unionByName(rest)


def over_last(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column], n: int, hot: int | None = None) -> DataFrame:
    """df with sums over the last n rows of a key, and `updates`, how many those are.

    Rows of keys that are too large for one window are dealt into stretches by their position; the last n - 1 rows of a
    stretch go to the next one as well, where they only count.
    """
    hot, names = HOT if hot is None else hot, df.columns

    def sums_over(some: DataFrame, w) -> DataFrame:
        last = w.rowsBetween(1 - n, 0)
        return some.select("*", F.count(F.lit(1)).over(last).alias("updates"), *[F.sum(c).over(last).alias(name) for name, c in sums.items()])

    if df.count() <= hot:
        return sums_over(df, Window.partitionBy(*keys).orderBy(*order))
    placed = running(df, keys, order, {"_scan_at": Fold("count", before=True)}, hot)
    length = max(hot // 2, n)
    stretch = F.expr(f"_scan_at div {length}")
    also = F.when(F.col("_scan_at") % length > length - n, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    dealt = placed.select("*", F.explode(also).alias("_scan_stretch"))
    told = sums_over(dealt, Window.partitionBy(*keys, "_scan_stretch").orderBy("_scan_at"))
    return told.where(F.col("_scan_stretch") == stretch).select(*names, "updates", *sums)
