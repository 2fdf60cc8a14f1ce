"""Embedding near-duplicates: int8 tile products with per-vector error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, cut


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and the length of what they miss, of unit vectors in double precision."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    missed = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) + 1e-12
    return codes.astype(np.int8), scale, missed


class Tile:
    """Vectors with their int8 codes, scales, error lengths and norms; single rows are computed in double precision.

    Vectors are first divided by the power of two above their largest component, which is exact, so that no square overflows or vanishes.
    """

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.ldexp(self.x[at].astype(np.float64), -self.power[at][:, None])

    def __init__(self, x: np.ndarray, step: int = 1024):
        self.x, self.step = x, step
        self.norm, self.scale, self.missed = (np.empty(len(x)) for _ in range(3))
        self.power = np.empty(len(x), np.int32)
        self.codes = np.empty(x.shape, np.int8)
        for k in range(0, len(x), step):
            part = x[k : k + step].astype(np.float64)
            self.power[k : k + step] = power = np.frexp(np.abs(part).max(1))[1]
            part = np.ldexp(part, -power[:, None])
            norm = self.norm[k : k + step] = np.sqrt((part * part).sum(1))
            self.codes[k : k + step], self.scale[k : k + step], self.missed[k : k + step] = quantise(part / norm[:, None])


def block_links(a: Tile, b: Tile, at: int, to: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine of a.x[i], b.x[j] at least threshold, in double precision, of the blocks of `step` rows at `at` and `to`.

    With x = x' + e and y = y' + f, |x.y - x'.y'| <= |e| + (1 + |e|) |f|. The product of the codes is
    exact in single precision (up to 1040 dimensions a slice). Only pairs whose bound reaches the
    threshold are computed in full.
    """
    p, q = slice(at, at + a.step), slice(to, to + b.step)
    qx, qy = a.codes[p], b.codes[q]
    product = np.zeros((len(qx), len(qy)))
    for d in range(0, qx.shape[1], 1024):
        product += qx[:, d : d + 1024].astype(np.float32) @ qy[:, d : d + 1024].astype(np.float32).T
    product *= a.scale[p][:, None]
    product *= b.scale[q][None, :]
    product += a.missed[p][:, None] + (1 + a.missed[p])[:, None] * b.missed[q][None, :]
    i, j = np.nonzero(product >= threshold - 1e-9)
    i, j = i + at, j + to
    kept = [np.zeros(0, bool)]
    for k in range(0, len(i), 32768):
        x, y = i[k : k + 32768], j[k : k + 32768]
        kept.append(np.einsum("ij,ij->i", a.rows(x), b.rows(y)) / (a.norm[x] * b.norm[y]) >= threshold)
    keep = np.concatenate(kept)
    return i[keep], j[keep]


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of all rows with cosine of x[i], y[j] at least threshold."""
    a, b = Tile(x), Tile(y)
    found = [block_links(a, b, at, to, threshold) for at in range(0, len(x), a.step) for to in range(0, len(y), b.step)]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _smallest(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place, given those known so far and more links i-j."""
    while True:
        after = low.copy()
        x, y = low[i], low[j]
        least = np.minimum(x, y)
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _pack(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("rep").to_numpy())
    table = table.take(order)
    row = {c: table.column(c)[0].as_py() for c in ("label", "dims", "t", "tiles")}
    row |= {"hs": table.column("h").to_pylist(), "reps": table.column("rep").to_pylist(), "copies": table.column("copies").to_pylist(), "block": b"".join(table.column("v").to_pylist())}
    return pa.Table.from_pylist([row], schema=_BLOCK)


_BLOCK = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("t", pa.int32()), ("tiles", pa.int32()), ("hs", pa.list_(pa.string())), ("reps", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("block", pa.binary())])


def _tile_pair(threshold: float, kind: type):
    """Over the one or two tiles of a pair: counts of links and spanning links. Pairs are looked at block by block."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["t"])
        dims, same = rows[0]["dims"], rows[0]["p"] == rows[0]["q"]
        if not same and len(rows) < 2:
            rows = []
        tiles = [Tile(np.frombuffer(r["block"], kind).reshape(-1, dims)) for r in rows]
        ids = np.array([i for r in rows for i in r["reps"]], np.int64)
        copies = np.array([i for r in rows for i in r["copies"]], np.int64)
        n, low = np.zeros(len(ids)), np.arange(len(ids))
        if rows:
            a, b, step = tiles[0], tiles[-1], tiles[0].step
            base = 0 if same else len(a.x)
            for at in range(0, len(a.x), step):
                for to in range(at if same else 0, len(b.x), step):
                    i, j = block_links(a, b, at, to, threshold)
                    j = j + base
                    if same:
                        i, j = i[(once := i < j)], j[once]
                    if len(i):
                        n += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                        low = _smallest(low, i, j)
        on = n > 0
        hs = np.array([h for r in rows for h in r["hs"]], object)
        size = int(on.sum())
        return pa.table({
            "label": pa.array([table.column("label")[0].as_py()] * size, pa.string()), "dims": pa.array([dims] * size, pa.int32()), "h": pa.array(hs[on].tolist() if size else [], pa.string()),
            "rep": ids[on], "n": n[on].astype(np.int64), "root": ids[low][on],
        })

    return run


#: Tiles of a label, as long as such a tile has not over TILE_BYTES of vectors.
TILES, TILE_BYTES = 8, 64 << 20


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile: int = 1024) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept (id = component_id).

    Vectors of equal non-null label and equal length link if their cosine in double precision is at
    least threshold. Null vectors, ids or labels, zero vectors and those with null or non-finite
    components link with nothing: n_links 0, own component (null without an id, then not kept).

    Equal vectors of a label become one row with a count before any product, so a vector that a
    third of all rows repeat is one column of a tile. Each label is split by hash into tiles of `tile`
    vectors or more: TILES of them, more only where those would exceed TILE_BYTES. Every pair of tiles is a unit of work
    of its own, looked at in blocks, and returns counts and spanning links only. So the work is quadratic in the
    distinct vectors of a label, as the method has it, but a vector travels TILES times at most until a label has
    TILES tiles of TILE_BYTES, and memory is that of two tiles. Vectors of floats travel as floats.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall("e", finite) & F.exists("e", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))

    kind = np.float32 if isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else np.float64

    def pack(batches):
        for batch in batches:
            e = batch.column(2)
            sizes = e.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            flat = e.flatten().to_numpy().astype(kind)
            raw = [flat[b - n : b].tobytes() for n, b in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dims", "v"])

    rows = clean.where(good).mapInArrow(pack, "id long, label string, dims int, v binary").withColumn("h", F.md5("v"))
    rows = cut(rows)
    distinct = rows.groupBy("label", "dims", "h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    distinct = cut(distinct)
    size = np.dtype(kind).itemsize
    tiles = F.greatest(F.least(F.lit(TILES), F.ceil(F.count("*") / tile)), F.ceil(F.count("*") * F.col("dims") * size / TILE_BYTES)).cast("int")
    counts = distinct.groupBy("label", "dims").agg(tiles.alias("tiles"))
    tiled = distinct.join(counts, ["label", "dims"]).withColumn("t", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
    schema = "label string, dims int, t int, tiles int, hs array<string>, reps array<long>, copies array<long>, block binary"
    blocks = cut(tiled.select("label", "dims", "t", "tiles", "h", "rep", "copies", "v").groupBy("label", "dims", "t").applyInArrow(_pack, schema))
    pairs = blocks.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("*", F.least("t", "u").alias("p"), F.greatest("t", "u").alias("q")).drop("u", "tiles")
    links = cut(pairs.groupBy("label", "dims", "p", "q").applyInArrow(_tile_pair(threshold, kind), "label string, dims int, h string, rep long, n long, root long"))
    totals = links.groupBy("label", "dims", "h").agg(F.sum("n").alias("n"))
    roots = connected_components(links, "rep", "root")
    found = distinct.join(totals, ["label", "dims", "h"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    found = found.select("label", "dims", "h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.join(found, ["label", "dims", "h"]).select("id", "n_links", "component_id")
    alone = clean.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
