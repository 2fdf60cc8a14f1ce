"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands for candidates, exact sets to decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, groups, lean, lookup, slices, texts_of
from .simhash import SEED, shingle_hashes

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: all but 6 in a million at 0.8.
BANDS, ROWS = 40, 6
_draw = np.random.default_rng(SEED)
_ADD = _draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _draw.integers(0, 1 << 31, BANDS * ROWS, np.uint32) << np.uint32(1) | np.uint32(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending; none without a word."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def node_of(codes: np.ndarray) -> int:
    """Signed name of a set: equal sets share it."""
    return int(np.uint64(xxhash.xxh64_intdigest(codes.tobytes(), SEED)).astype(np.int64))


def bands(codes: np.ndarray) -> np.ndarray:
    """A signed key for each band of a set's MinHash values."""
    codes = codes.astype(np.uint32)  # the low halves, in blocks that stay in the processor's caches
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(codes), 256):
        np.minimum(least, ((codes[i : i + 256, None] ^ _ADD) * _TIMES).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for x in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def exact_roots(sets: list[np.ndarray], least: float, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the first one that it reaches by pairs of similarity `least` or more.

    Breadth-first, as in a bucket of fingerprints: each set meets only those not reached yet, and with
    `side` (0 or 1 for each set) only those of the other side.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    roots = np.full(len(sets), -1, np.int64)
    rest, rest_flat, rest_starts = np.arange(len(sets)), flat, starts
    mark = np.zeros(len(names), bool)
    for first in range(len(sets)):
        if roots[first] >= 0:
            continue
        roots[first], queue = first, [first]
        while queue:
            at = queue.pop()
            left = roots[rest] < 0
            if not left.any():
                return roots
            if left.mean() < 0.7:
                rest = rest[left]
                rest_flat = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in rest])
                rest_starts, left = np.cumsum(sizes[rest]) - sizes[rest], np.ones(len(rest), bool)
            if side is not None:
                left &= side[rest] != side[at]
            own = flat[starts[at] : starts[at] + sizes[at]]
            mark[own] = True
            shared = np.add.reduceat(mark[rest_flat], rest_starts, dtype=np.int64)
            mark[own] = False
            found = rest[left & (shared >= least * (sizes[at] + sizes[rest] - shared))]
            roots[found] = first
            queue += found.tolist()
    return roots


def _prints(width: int):
    def run(batches):
        for batch in slices(batches, 4 << 20):
            sets = [shingle_set(x, width) for x in texts_of(batch.column(1))]
            keys = [bands(x) if len(x) else np.zeros(0, np.int64) for x in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            columns = [batch.column(0), pa.array(list(map(node_of, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "size", "bands"])

    return run


def _chain(batches):
    """Over rows sorted by key: a link from each row to the one before, within a key."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if before is not None:
            key, node = np.append(before[0], key), np.append(before[1], node)
        same = key[1:] == key[:-1]
        before = key[-1:].copy(), node[-1:].copy()
        yield pa.RecordBatch.from_arrays([pa.array(node[:-1][same]), pa.array(node[1:][same])], ["a", "b"])


def _sets(width: int):
    """Over (rep, component, tiles, text): the set of each text, and the tile of its component that it is in."""

    def run(batches):
        for batch in slices(batches, 4 << 20):
            rep, component, tiles = (batch.column(i) for i in range(3))
            sets = [shingle_set(x, width) for x in texts_of(batch.column(3))]
            mixed = rep.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            tile = ((mixed ^ (mixed >> np.uint64(32))) % tiles.to_numpy().astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([component, tiles, pa.array(tile), rep, pa.array([x.tobytes() for x in sets], pa.binary())], ["component", "tiles", "tile", "rep", "codes"])

    return run


def _decide(least: float):
    """Over rows (component, p, q, tile, rep, codes) sorted by the first three: links (a, b) that span what is similar within a
    tile (p = q) or between two."""

    def run(batches):
        for table in groups(batches, 3):
            table = table.sort_by("rep")
            tile, rep = table.column("tile").to_numpy(), table.column("rep").to_numpy()
            side = tile == tile[0] if table.column("p")[0] != table.column("q")[0] else None
            roots = exact_roots([np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()], least, side)
            on = roots != np.arange(len(roots))
            yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[roots[on]])], ["a", "b"])

    return run


#: Sets and shingles of a tile, and tiles of a component, as long as a tile of TILE_SHINGLES allows no more.
TILE, TILE_SHINGLES, TILES = 96, 4 << 20, 64


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """(id, component_id) of every row of docs, whose ids are distinct and not null.

    Texts whose sets of `width`-word shingles have a Jaccard similarity of `least` or more are linked;
    component_id is the smallest id reachable. A shorter text is one shingle, a text without a word the
    empty set. Bands only choose which texts are compared; the whole sets decide. Equal sets are one
    node, so copies never meet.

    Texts that candidates connect are compared all with all, but not in one task: a group of over about
    `tile` texts is dealt into tiles, and each pair of tiles is a task's unit of work. A set is sent once for
    each tile of its group, TILES times at most as long as TILES tiles of TILE_SHINGLES hold the group.
    """
    prints, nodes, decided = _linked(docs, id_col, text_col, width, least, tile)
    roots = connected_components(decided)
    by_node = nodes.select("node", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("id", "node").join(by_node, "node").select(F.col("id").alias(id_col), "component_id")


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """(a, b): links of ids whose components are those of similar(), for callers that have more links to add."""
    prints, nodes, decided = _linked(docs, id_col, text_col, width, least, tile)
    return decided.unionByName(prints.select("id", "node").join(nodes.select("node", "rep"), "node").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prints of all rows, the distinct sets as nodes, and spanning links (a, b) between their reps."""
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = cut(rows.mapInArrow(_prints(width), "id long, node long, size long, bands array<long>"))
    nodes = cut(prints.groupBy("node").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    keys = nodes.select(F.explode("bands").alias("key"), F.col("rep"))
    links = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_chain, "a long, b long")
    found = cut(connected_components(links).select(F.col("node").alias("rep"), "component"))
    totals = lookup(nodes.select("rep", "size"), found, "rep").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    tiles = F.when(F.col("n") < 2 * tile, 1).otherwise(F.least(F.lit(TILES), F.ceil(F.col("n") / tile)))
    tiles = F.greatest(tiles, F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    many = cut(totals.select("component", tiles.alias("tiles")).where("tiles > 1"))
    placed = cut(lookup(found, many, "component", "left").select("rep", "component", F.coalesce("tiles", F.lit(1)).alias("tiles")))
    chosen = lookup(rows.withColumnRenamed("id", "rep"), placed, "rep").select("rep", "component", "tiles", "text")
    sets = chosen.mapInArrow(_sets(width), "component long, tiles int, tile int, rep long, codes binary")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("component", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "rep", "codes")
    decided = dealt.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").mapInArrow(_decide(least), "a long, b long")
    return prints, nodes, decided
