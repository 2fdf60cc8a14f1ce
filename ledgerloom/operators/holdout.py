"""Splits, exposure and protected sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins
from .ordered import overlaps

SPLITS = ("training", "development", "test", "excluded")


def assignment_problems(assignments: DataFrame) -> DataFrame:
    """(accession, rule) of assignments (accession, split, group_id, development_exposed) that break a rule.

    One aggregate by group decides exposure and crossing; excluded sources don't count for a split.
    """
    groups = assignments.groupBy("group_id").agg(F.bool_or("development_exposed").alias("exposed"), F.count_distinct(F.when(F.col("split") != "excluded", F.col("split"))).alias("splits"))
    both = assignments.join(groups, "group_id")
    found = F.array_compact(F.array(
        F.when(~F.col("split").isin(*SPLITS), F.lit("unknown_split")),
        F.when(F.col("exposed") & (F.col("split") == "training"), F.lit("exposed_group_in_training")),
        F.when((F.col("splits") > 1) & (F.col("split") != "excluded"), F.lit("group_crosses_splits")),
    ))
    return both.select("accession", F.explode(found).alias("rule"))


def selection_problems(selections: DataFrame, assignments: DataFrame) -> DataFrame:
    """(packet_id, rule): selections without an equal assignment, and targets that overlap in a source."""
    known = assignments.select("accession", F.col("split").alias("s"), F.col("group_id").alias("g"))
    both = selections.join(known, "accession", "left")
    differ = both.where(~(F.col("split").eqNullSafe(F.col("s")) & F.col("group_id").eqNullSafe(F.col("g")))).select("packet_id", F.lit("differs_from_assignment").alias("rule"))
    flat = selections.select("packet_id", "source_sha256", F.col("target.a").alias("a"), F.col("target.b").alias("b"))
    clash = overlaps(flat, ["source_sha256"], "a", "b", ["a", "b", "packet_id"]).select("packet_id", F.lit("target_overlaps").alias("rule"))
    return differ.unionByName(clash)


def protected_keys(ledger: DataFrame) -> DataFrame:
    """(kind, key) of protected sources (accession, aliases, group_id, family_id, cik, sha256[])."""
    c = F.col
    both = {"accession": F.concat(F.array("accession"), F.coalesce("aliases", F.array().cast("array<string>"))), "group": F.array("group_id", "family_id"), "hash": c("sha256"), "cik": c("cik")}
    return joins.keyed(ledger, both).distinct()


def protected_selections(selections: DataFrame, ledger: DataFrame, folder: str = "data/raw/test/") -> DataFrame:
    """packet_id of training and development selections that any key, or the folder, ties to a protected source.

    selections: packet_id, split, accession, group_id, family_id, source_sha256, source_path, ciks array.
    """
    c = F.col
    open_ = selections.where(c("split").isin("training", "development"))
    keys = {"accession": c("accession"), "group": F.array("group_id", "family_id"), "hash": c("source_sha256"), "cik": c("ciks")}
    hit = joins.reached(open_, "packet_id", keys, protected_keys(ledger))
    return hit.union(open_.where(c("source_path").startswith(folder)).select("packet_id")).distinct()


def reserve(ledger: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The protected ledger with proposed sources (accession, group_id, family_id, cik, sha256[]), and conflicts.

    Hashes become the sorted union; another group, key or family under a known accession is a conflict
    and changes nothing.
    """
    a = ledger.select("accession", F.struct("group_id", "family_id", "cik", "sha256").alias("k"))
    b = proposed.groupBy("accession").agg(F.struct(F.min("group_id").alias("group_id"), F.min("family_id").alias("family_id"), F.min("cik").alias("cik"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sha256")))).alias("sha256")).alias("p"))
    both = a.join(b, "accession", "full_outer")
    k, p = (lambda x: F.col(f"k.{x}")), (lambda x: F.col(f"p.{x}"))
    clash = F.col("k").isNotNull() & F.col("p").isNotNull() & (~k("group_id").eqNullSafe(p("group_id")) | ~k("cik").eqNullSafe(p("cik")) | F.coalesce(k("family_id") != p("family_id"), F.lit(False)))
    take = F.col("p").isNotNull() & ~clash
    hashes = F.array_sort(F.array_union(F.coalesce(k("sha256"), F.array().cast("array<string>")), F.coalesce(p("sha256"), F.array().cast("array<string>"))))
    merged = both.select(
        "accession", F.coalesce(k("group_id"), p("group_id")).alias("group_id"), F.when(take, F.coalesce(k("family_id"), p("family_id"))).otherwise(k("family_id")).alias("family_id"),
        F.coalesce(k("cik"), p("cik")).alias("cik"), F.when(take, hashes).otherwise(k("sha256")).alias("sha256"),
    )
    return merged, both.where(clash).select("accession")


def dropped_reservations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Accessions of which a reserved hash is gone."""
    both = before.select("accession", F.col("sha256").alias("was")).join(after.select("accession", F.col("sha256").alias("now")), "accession", "left")
    return both.where(F.col("now").isNull() | (F.size(F.array_except("was", "now")) > 0)).select("accession")


def year_mismatch(selections: DataFrame, expected: list[int]) -> DataFrame:
    """(year, found, expected) for every year whose number of filings is not the expected one. Null: no such date."""
    counts = selections.groupBy(F.year(F.try_to_date("filing_date", "yyyy-MM-dd")).alias("year")).agg(F.count("*").alias("found"))
    want = selections.sparkSession.createDataFrame([(y, expected.count(y)) for y in sorted(set(expected))], "year int, expected long")
    both = counts.join(want, counts.year.eqNullSafe(want.year), "full_outer")
    rows = both.select(F.coalesce(counts.year, want.year).alias("year"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return rows.where("found <> expected")


def evidence_problems(evidence: DataFrame, frozen: bool = False) -> DataFrame:
    """Ids whose byte range (a, b) of content does not hash to slice_sha256; frozen evidence, whose sources need not
    be there any more, only has to name a range and a hash."""
    if frozen:
        told = (F.col("a") >= 0) & (F.col("a") < F.col("b")) & F.col("slice_sha256").rlike("^[0-9a-f]{64}$")
        return evidence.where(~F.coalesce(told, F.lit(False))).select("id")
    held = F.substring(F.col("content"), F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int"))
    ok = (F.col("a") >= 0) & (F.col("a") < F.col("b")) & (F.col("b") <= F.octet_length("content")) & (F.sha2(held, 256) == F.col("slice_sha256"))
    return evidence.where(~F.coalesce(ok, F.lit(False))).select("id")
