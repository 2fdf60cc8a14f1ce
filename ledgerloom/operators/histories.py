"""Histories of training: rows chained by hashes, the longest sound chain of a run, and where to resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import finite
from ..sources.scratch import cut
from .scan import Fold, running


def history_problems(rows: DataFrame, run: str = "run", order: str = "position") -> DataFrame:
    """(run, position, rule) of history rows (step, response_tokens, loss, update_seconds): steps count from one, and each update is sound."""
    told = running(rows, [run], [order], {"_n": Fold("count")})
    c = F.col
    broken = F.array_compact(F.array(
        F.when(~F.coalesce(c("step") == c("_n"), F.lit(False)), "step"), F.when(~F.coalesce(c("response_tokens") > 0, F.lit(False)), "tokens"),
        F.when(~(finite(c("loss")) & finite(c("update_seconds")) & F.coalesce(c("update_seconds") >= 0, F.lit(False))), "measurement"),
    ))
    return told.select(run, order, F.explode(broken).alias("rule"))


def chained(rows: DataFrame, run: str = "run", own: str = "hash", parent: str = "parent", sound: str = "sound") -> DataFrame:
    """rows with `depth`: how many rows their chain has back to a first row (parent null), itself included; null where the chain is cut.

    A chain is cut by a row that is not sound, by a parent that is not there, and by a ring. Rows point to what they follow, and in each round
    every pointer jumps to where its target points, so that a chain of n rows takes log n joins, each a checkpoint. Own
    hashes are unique in a run; where they are not, all rows of that hash are cut off. A null run is a run like others, a null hash is no row's parent.
    """
    key = [F.coalesce(F.col(run).cast("string"), F.lit("")), F.col(run).isNull().cast("string")]
    named = rows.withColumn("_run", F.concat_ws("\x1f", *key))
    twice = named.groupBy("_run", own).agg(F.count("*").alias("_same"))
    one = named.select("_run", F.col(own).alias("node"), F.col(parent).alias("at"), F.coalesce(F.col(sound), F.lit(False)).alias("ok")).join(twice.select("_run", F.col(own).alias("node"), "_same"), ["_run", "node"])
    # at: the next row to look at, null at the chain's beginning; length: rows from this one to before it.
    links = cut(one.groupBy("_run", "node", "_same").agg(F.min("at").alias("at"), F.bool_and("ok").alias("ok")).select("_run", "node", "at", F.lit(1).cast("long").alias("length"), (F.col("ok") & (F.col("_same") == 1)).alias("ok")))
    rounds = max(1, links.groupBy("_run").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]).bit_length()
    for _ in range(rounds):
        if links.where("ok and at is not null").isEmpty():
            break
        ends = links.select("_run", F.col("node").alias("at"), F.col("at").alias("then"), F.col("length").alias("more"), F.col("ok").alias("fine"))
        both = links.join(ends, ["_run", "at"], "left")
        open_ = F.col("at").isNotNull()
        jumped = both.select(
            "_run", "node", F.when(open_, F.col("then")).alias("at"), (F.col("length") + F.when(open_, F.coalesce("more", F.lit(0))).otherwise(0)).alias("length"),
            (F.col("ok") & (~open_ | F.coalesce("fine", F.lit(False)))).alias("ok"),
        )
        links = cut(jumped)
    done = links.where("ok and at is null").select("_run", F.col("node").alias(own), F.col("length").alias("depth"))
    return named.join(done, ["_run", own], "left").select(*rows.columns, "depth").drop("_run")


def resume_points(chains: DataFrame, run: str = "run", own: str = "hash") -> DataFrame:
    """(run, hash, depth, rows, cut_off): the end of each run's longest sound chain, the least hash of several; nulls and 0 if there is none."""
    longest = chains.groupBy(run).agg(F.max("depth").alias("depth"), F.count("*").alias("rows"), F.count_if(F.col("depth").isNull()).alias("cut_off"))
    ends = chains.join(longest.select(F.col(run).alias("_run"), F.col("depth").alias("_most")), F.col(run).eqNullSafe(F.col("_run")) & (F.col("depth") == F.col("_most"))).groupBy(run).agg(F.min(own).alias(own))
    ends = ends.select(F.col(run).alias("_run"), own)
    return longest.join(ends, F.col(run).eqNullSafe(F.col("_run")), "left").select(run, own, F.coalesce("depth", F.lit(0)).alias("depth"), "rows", "cut_off")
