"""Joins of the audit: protected sets, inventories, keyed merges, quotations, positions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams
from ..sources.scratch import cut


def keyed(df: DataFrame, keys: dict[str, Column], *keep: str) -> DataFrame:
    """A row (kind, key) for each key of a row that is not null; an array gives one for each element."""
    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("key"))

    parts = []
    for kind, column in keys.items():
        is_array = df.select(column.alias("c")).schema["c"].dataType.typeName() == "array"
        parts.append(F.transform(column if is_array else F.array(column), named(kind)))
    some = reduce(lambda a, b: F.concat(a, b), [F.coalesce(p, F.array().cast("array<struct<kind:string,key:string>>")) for p in parts])
    return df.select(*keep, F.explode(some).alias("k")).select(*keep, "k.kind", "k.key").where("key is not null")


def reached(candidates: DataFrame, entity: str, keys: dict[str, Column], protected: DataFrame) -> DataFrame:
    """Ids of candidates that share any (kind, key) with the protected rows.

    A disjunction over kinds of keys as one equi semi join, which no theta join has to check.
    """
    return keyed(candidates, keys, entity).join(protected.select("kind", "key"), ["kind", "key"], "left_semi").select(entity).distinct()


def inventory_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): added, removed or changed between two inventories; equal rows are left out."""
    a, b = left.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")), right.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def merge(known: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The keyed table after a merge, and its conflicts.

    A key with an equal value is left as it is, so a repeated merge changes nothing; a key with
    another value is a conflict and keeps the known one.
    """
    new = new.groupBy(key).agg(F.min(value).alias("new"), F.count_distinct(value).alias("values"))
    both = known.select(key, F.col(value).alias("old"), F.lit(True).alias("kept")).join(new, key, "full_outer")
    clash = both.where((F.col("values") > 1) | (F.col("kept") & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))))
    return both.select(key, F.when(F.col("kept"), F.col("old")).otherwise(F.col("new")).alias(value)), clash.select(key, "old", "new")


def supported(quote: Column, cells: Column) -> Column:
    """True if one cell alone holds the quotation, compared exactly; an empty quotation never is."""
    return (F.length(quote) > 0) & F.exists(cells, lambda c: F.contains(c, quote))


def _grams_of(widths: list[int] | None, key: str):
    """(key, width, gram) of texts; of all given widths, or of the text's own where none are given."""

    def told(held: list):
        rows, some, found = zip(*held)
        sizes = [len(f) for f in found]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.repeat(r, n) for r, n in zip(rows, sizes)]), pa.array(np.repeat(some, sizes), pa.int32()), pa.array(np.concatenate(found))], [key, "width", "gram"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_buffer().to_pybytes()
                for width in [w for w in widths if w <= len(data)] if widths is not None else [grams.width_of(len(data))]:
                    held.append((batch.column(0)[k], width, grams.grams(data, width)))
                    size += len(held[-1][2])
                if size > 1 << 18:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    return run


def anchors(quotes: DataFrame) -> DataFrame:
    """(quote, width, gram) of distinct quotations that are not empty: of a quotation's grams, the one that fewest others have."""
    each = quotes.select("quote", F.col("quote").cast("binary").alias("b")).mapInArrow(_grams_of(None, "quote"), "quote string, width int, gram long")
    each = cut(each)
    counts = each.groupBy("width", "gram").agg(F.count("*").alias("n"))
    return each.join(counts, ["width", "gram"]).groupBy("quote", "width").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def _few(df: DataFrame, size: Column, rows: int, held: int) -> DataFrame:
    """A checkpoint, to be broadcast while it is counted to hold at most so many rows and bytes."""
    n, total = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= held else df


def quotations_in(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, quote: str, rows: int = 1 << 17, held: int = 32 << 20) -> DataFrame:
    """(doc, item) where the document holds the whole quotation, compared exactly, byte by byte.

    Each distinct quotation is found by one gram of it, its rarest, in an equi join with the grams of the texts: of those only the least of each
    window travel, which any text with the quotation shares. Pairs that share one are compared in full. The driver holds no
    quotation; anchors are broadcast while they are counted to be at most `rows` and of `held` bytes, else both sides are shuffled, and so
    are the documents that may hold a quotation. Quotations of under 8 bytes meet every gram of the texts.
    Null texts and quotations, and empty quotations, are in nothing; documents and items without an id are left
    out. Rows that repeat an id count apart.
    """
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.col(quote).alias("quote")).where("item is not null and length(quote) > 0")
    told = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    known = cut(anchors(asked.select("quote").distinct()))
    widths = sorted(known.agg(F.collect_set("width")).first()[0])  # at most one for each of GRAMS
    met = told.select("doc", F.col("text").cast("binary").alias("b")).mapInArrow(_grams_of(widths, "doc"), "doc long, width int, gram long")
    pairs = cut(met.join(_few(known, F.octet_length("quote"), rows, held), ["width", "gram"]).select("doc", "quote").distinct())
    size = F.octet_length("quote")
    found = told.join(_few(pairs, size, rows, held), "doc").where(F.contains("text", F.col("quote"))).select("doc", "quote")
    return found.join(asked, "quote").select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of expected that have no row in found."""
    return expected.join(found.select(key), key, "left_anti")
