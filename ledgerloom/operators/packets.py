"""Packets: selected byte ranges of a source, its cells, gaps and marked target, as text for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..functions.markup import blocks
from ..functions.text import json_quoted
from .rules import Rule

SELECTION = "packet_id string, accession string, source_path string, source_sha256 string, encoding string, split string, group_id string, spans array<struct<a:bigint,b:bigint,kind:string>>, target struct<a:bigint,b:bigint>, boundary_review string, reviewer string"
PARTITIONS = ("training", "development", "test")


def selection_rules() -> list[Rule]:
    """What a selection joined with its source (content, sha256, length; null where there is none) may not be."""
    c, spans = F.col, F.col("spans")
    pair = lambda f: F.exists(F.sequence(F.lit(1), F.greatest(F.size(spans) - 1, F.lit(1))), lambda i: F.coalesce(f(F.get(spans, i - 1), F.get(spans, i)), F.lit(False)))
    inside = F.filter(spans, lambda s: (s["a"] >= c("target.a")) & (s["a"] < s["b"]) & (s["b"] <= c("target.b")))
    apart = F.exists(F.sequence(F.lit(1), F.greatest(F.size(inside) - 1, F.lit(1))), lambda i: F.coalesce(F.get(inside, i - 1)["b"] != F.get(inside, i)["a"], F.lit(False)))
    whole = (F.size(inside) > 0) & (F.get(inside, F.lit(0))["a"] == c("target.a")) & (F.get(inside, F.size(inside) - 1)["b"] == c("target.b")) & ~apart
    return [
        Rule("path", c("source_path").startswith("/") | c("source_path").rlike("(^|/)\\.\\.(/|$)"), "the path leaves its root", "source_path"),
        Rule("source", c("sha256").isNull() | (c("sha256") != c("source_sha256")), "no such source, or its hash differs", "source_sha256"),
        Rule("partition", ~c("split").isin(*PARTITIONS), "unknown partition", "split"),
        Rule("review", (F.coalesce("boundary_review", F.lit("")) == "") | (F.coalesce("reviewer", F.lit("")) == ""), "the boundary is not reviewed", "boundary_review"),
        Rule("spans", F.coalesce(F.size(spans) < 1, F.lit(True)) | F.exists(spans, lambda s: ~((s["a"] >= 0) & (s["a"] < s["b"]) & (s["b"] <= c("length")))), "ranges are missing or out of bounds", "spans"),
        Rule("order", (F.size(spans) > 1) & pair(lambda x, y: x["b"] > y["a"]), "ranges overlap or are out of order", "spans"),
        Rule("target_kind", F.exists(inside, lambda s: s["kind"] == "cell"), "a lone cell is no target", "target"),
        Rule("target", ~F.coalesce(whole, F.lit(False)), "the target is not made of whole adjacent ranges", "target"),
    ]


def with_source(selections: DataFrame, sources: DataFrame) -> DataFrame:
    """Selections with content, sha256 and length of their source, by path."""
    return selections.join(sources.select(F.col("path").alias("source_path"), "content", "sha256", "length"), "source_path", "left")


def packet_blocks(selected: DataFrame) -> DataFrame:
    """A row for each range of a selection: packet_id, block_index, block_id, is_target, previous end and the block."""
    each = selected.select("packet_id", "content", "encoding", "target", "length", F.posexplode("spans").alias("block_index", "s"))
    found = each.select(
        "packet_id", "block_index", "length", F.concat(F.lit("B"), F.col("block_index") + 1).alias("block_id"),
        ((F.col("s.a") >= F.col("target.a")) & (F.col("s.b") <= F.col("target.b"))).alias("is_target"),
        blocks(F.col("content"), F.col("s.a"), F.col("s.b"), F.col("s.kind"), F.coalesce("encoding", F.lit("utf-8"))).alias("block"),
    )
    return found.withColumn("previous", F.coalesce(F.lag("block.end_byte").over(Window.partitionBy("packet_id").orderBy("block_index")), F.lit(0)))


def context_blocks(contexts: DataFrame, accessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of other documents of the same filing, with ids such as D1:B2, and contexts that are refused.

    contexts: packet_id, document_index (from 1), accession, association_review, content, encoding, spans;
    accessions: packet_id, own_accession. Another accession, or no review, refuses a context.
    """
    both = contexts.join(accessions, "packet_id")
    bad = ~F.col("accession").eqNullSafe(F.col("own_accession")) | (F.coalesce("association_review", F.lit("")) == "")
    each = both.where(~bad).select("packet_id", "document_index", "content", "encoding", F.octet_length("content").alias("length"), F.posexplode("spans").alias("block_index", "s"))
    found = each.select(
        "packet_id", "document_index", "block_index", "length", F.format_string("D%d:B%d", "document_index", F.col("block_index") + 1).alias("block_id"), F.lit(False).alias("is_target"),
        blocks(F.col("content"), F.col("s.a"), F.col("s.b"), F.col("s.kind"), F.coalesce("encoding", F.lit("utf-8"))).alias("block"),
    )
    return found, both.where(bad).select("packet_id", "document_index")


def source_cells(found: DataFrame) -> DataFrame:
    """(packet_id, block_index, cell_index, text, start_byte, end_byte) of all cells."""
    cells = found.select("packet_id", "block_index", F.posexplode("block.cells").alias("cell_index", "c"))
    return cells.select("packet_id", "block_index", "cell_index", "c.text", "c.start_byte", "c.end_byte")


# The lines that a model input is made of.
OMITTED, BEGIN, END = "[OMITTED%s SOURCE BYTES %d:%d]", "BEGIN MARKED TARGET", "END MARKED TARGET"


def _cell(c: Column) -> Column:
    spans = [F.when(c[k].isNotNull(), F.concat(F.lit(f" {k}="), c[k])).otherwise("") for k in ("colspan", "rowspan")]
    return F.concat(json_quoted(c["text"]), *spans)


def model_inputs(found: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """(packet_id, model_input): gaps, titles and quoted cells in order, with the target marked.

    contexts: the blocks of context_blocks(). A packet's other documents come first, each with its own gaps;
    the own document's blocks are then numbered as the next document's.
    """
    own = found
    if contexts is not None:
        last = contexts.groupBy("packet_id").agg(F.max("document_index").alias("documents"))
        prefix = F.coalesce(F.format_string("D%d:", F.col("documents") + 1), F.lit(""))
        own = found.join(last, "packet_id", "left").withColumn("block_id", F.concat(F.when(F.col("documents").isNull(), F.lit("")).otherwise(prefix), F.col("block_id"))).drop("documents")
    told = _document_lines(own.withColumn("document_index", F.lit(1 << 30)))
    if contexts is not None:
        before = F.coalesce(F.lag("block.end_byte").over(Window.partitionBy("packet_id", "document_index").orderBy("block_index")), F.lit(0))
        told = told.unionByName(_document_lines(contexts.withColumn("previous", before)))
    whole = told.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("document_index", "lines"))).alias("x"))
    return whole.select("packet_id", F.array_join(F.flatten(F.transform("x", lambda r: r["lines"])), "\n").alias("model_input"))


def _document_lines(found: DataFrame) -> DataFrame:
    """(packet_id, document_index, lines) of the blocks of documents."""
    w = Window.partitionBy("packet_id", "document_index").orderBy("block_index")
    first = F.col("is_target") & ~F.coalesce(F.lag("is_target").over(w), F.lit(False))
    last = F.col("is_target") & ~F.coalesce(F.lead("is_target").over(w), F.lit(False))
    cells = found.withColumn("begins", first).withColumn("ends", last).select("*", F.posexplode("block.cells").alias("cell_index", "c"))
    told = cells.select("packet_id", "document_index", "block_index", "block_id", "previous", "length", "begins", "ends", "cell_index", _cell(F.col("c")).alias("cell"), F.col("block.start_byte").alias("a"), F.col("block.end_byte").alias("b"))
    rows = told.groupBy("packet_id", "document_index", "block_index", "block_id", "previous", "length", "begins", "ends", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_index", "cell"))), lambda x: x["cell"]), " | ").alias("cells"))
    title = F.format_string("%s source bytes %d:%d\n%s", "block_id", "a", "b", "cells")
    name = F.when(F.col("document_index") < 1 << 30, F.format_string(" D%d", "document_index")).otherwise("")
    gap = lambda a, b: F.format_string(OMITTED, name, a, b)
    lines = F.array_compact(F.array(F.when(F.col("a") > F.col("previous"), gap("previous", "a")), F.when(F.col("begins"), F.lit(BEGIN)), title, F.when(F.col("ends"), F.lit(END))))
    packets = rows.groupBy("packet_id", "document_index").agg(F.array_sort(F.collect_list(F.struct("block_index", lines.alias("lines")))).alias("x"), F.max("b").alias("reach"), F.first("length").alias("length"))
    rest = F.when(F.col("reach") < F.col("length"), gap("reach", "length"))
    return packets.select("packet_id", "document_index", F.array_compact(F.concat(F.flatten(F.transform("x", lambda r: r["lines"])), F.array(rest))).alias("lines"))


def target_ids() -> Column:
    """target_id() of a selection's columns accession, source_sha256 and target."""
    parts = [json_quoted(F.col("accession")), F.lit(","), json_quoted(F.col("source_sha256")), F.format_string(",[%d,%d]", "target.a", "target.b")]
    return F.sha2(F.concat(F.lit("["), *parts, F.lit("]")), 256)


def target_id(accession: str, source_sha256: str, a: int, b: int) -> str:
    """Identity of a target."""
    return digest([accession, source_sha256, [a, b]], "target")


def unsupported(quotes: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (packet_id, path, quote) whose quotation no single cell of the packet holds.

    Cells are gathered by packet before the test, so that no substring join is planned.
    """
    held = cells.groupBy("packet_id").agg(F.collect_list("text").alias("cells"))
    both = quotes.join(held, "packet_id", "left")
    ok = (F.length("quote") > 0) & F.exists("cells", lambda c: F.contains(c, F.col("quote")))
    return both.where(~F.coalesce(ok, F.lit(False))).select(quotes.columns)
