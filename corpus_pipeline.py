"""The corpus pipeline: language, near-duplicates, secrets, mixture, tokens.

Each stage takes and, but for the last, returns the columns of documents, with its decisions applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, mixing, pieces, secrets, simhash
from ledgerloom.llm.common import connected_components, cut, forget, lookup, scratch_path
from ledgerloom.llm.similar import similar_links

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letter (null and empty texts too), or so few n-grams
    that any landmark has that the text is in no learned language. A missing lang is filled with the one found.
    Repeated rows and rows without an id stay."""
    model = langid.train(docs)
    found = langid.identify(docs, model, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known") >= (model.least if model else 0.0)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id; rows that repeat
    that id become one (the smallest by the other columns). Rows without an id go."""
    kept = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi")
    return known.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id. Two are linked if their
    five-word shingles have a Jaccard similarity of 0.8 or more, or their fingerprints are close as in
    `drop_near_duplicates`. Rows that repeat an id are one before (the smallest by the other columns).
    Rows without an id go."""
    known = docs.where("doc_id is not null").select(*COLUMNS)
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        one = known.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x"))
        known = cut(one.select("doc_id", "x.*"))
    roots = connected_components(simhash.near_links(known).unionByName(similar_links(known)))
    dropped = cut(roots.where("node <> component").select(F.col("node").alias("doc_id")))
    return lookup(known, dropped, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; no document goes, and null texts and repeated rows stay as they are."""
    found = secrets.find_secrets(docs, redacted=True, keep=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mixture takes it; those not taken go, and rows without
    an id. Rows that repeat an id are each taken as often as the one of them that is taken most."""
    taken = cut(mixing.mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies")))
    return lookup(docs, taken, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row of the mixture, repeated ones too; a null text has null ids."""
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES = [
    ("language", keep_identified),
    ("near_duplicates", drop_similar),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]

#: The stages have no statement in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next, then deleted.

    What the last one reads stays, as the result is lazy."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
