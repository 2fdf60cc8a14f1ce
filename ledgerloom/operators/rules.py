"""Validation as data: every broken rule is a row, and publishing asks for none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where `broken` is true; null is not broken."""

    name: str
    broken: Column
    message: str
    path: str = ""


class Violated(ValueError):
    """Rows that break rules stand in the way."""


def violations(df: DataFrame, entity: str, rules: list[Rule]) -> DataFrame:
    """(entity_id, rule_order, rule_id, path, message), a row for each rule that a row breaks. One pass."""
    each = [F.when(r.broken, F.struct(F.lit(i).alias("rule_order"), F.lit(r.name).alias("rule_id"), F.lit(r.path).alias("path"), F.lit(r.message).alias("message"))) for i, r in enumerate(rules)]
    found = df.select(F.col(entity).cast("string").alias("entity_id"), F.explode(F.array_compact(F.array(*each))).alias("v"))
    return found.select("entity_id", "v.*")


def first_violation(found: DataFrame) -> DataFrame:
    """For each entity the message of the rule that comes first."""
    return found.groupBy("entity_id").agg(F.min_by(F.struct("rule_id", "path", "message"), "rule_order").alias("v")).select("entity_id", "v.*")


def require_empty(found: DataFrame, show: int = 5) -> None:
    """Raises Violated, naming a few, if there is any violation."""
    some = found.take(show)
    if some:
        raise Violated("; ".join(str(r.asDict()) for r in some))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with counts on both sides that differ, each side counted before the join."""
    a = expected.groupBy(*keys).agg(F.count("*").alias("n_expected"))
    b = found.groupBy(*keys).agg(F.count("*").alias("n_found"))
    both = a.join(b, keys, "full_outer").fillna(0, ["n_expected", "n_found"])
    return both.where("n_expected <> n_found")
