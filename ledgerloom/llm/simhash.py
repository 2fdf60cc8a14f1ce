"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, groups, lean, lookup, slices, texts_of

SEED = 42
BITS = 64


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of `width` words of an ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: bytes, width: int) -> int:
    """Signed 64-bit SimHash: a bit is 1 if over half of the shingle hashes set it; zero without a word."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits such that any radius positions are all outside some mask.

    Bit i gets a non-zero code of radius+1 bits; mask v holds the bits whose code has odd overlap
    with v. For any radius codes some v not zero is orthogonal to them all (radius equations in
    radius+1 unknowns), so two fingerprints that differ in those bits only agree under mask v.
    Each mask keeps about half of the bits.
    """
    codes = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if (v & (i % codes + 1)).bit_count() % 2) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(prints: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that span, for one bucket, the components of "differs in radius bits or fewer".

    With `side` (true or false for each print) only links between the sides count.

    Breadth-first: each print meets only the prints not reached yet, so a dense group of n copies
    costs about n comparisons instead of n squared, and n - 1 links instead of all pairs.
    """
    rest = np.arange(len(prints))
    left, right = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= radius
            if side is not None:
                near &= side[rest] != side[at]
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left += [root] * len(found)
                right += found.tolist()
                queue += found.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


_LINKS = "a long, b long, t int, key long, fp long"


def _emit(a: np.ndarray, b: np.ndarray, t=None, key=None, fp=None) -> pa.RecordBatch:
    """Links (a, b); or, with t, rows of a bucket that is to be dealt out, b being the node."""
    kinds = ((a, pa.int64()), (b, pa.int64()), (t, pa.int32()), (key, pa.int64()), (fp, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.nulls(len(b), k) if x is None else pa.array(x, k) for x, k in kinds], ["a", "b", "t", "key", "fp"])


def _link_buckets(radius: int, most: int):
    """Over rows (t, key, fp, rep) sorted by (t, key): links of each bucket. A bucket may go on in the next batch.

    A bucket of more than `most` rows is handed on as it is, batch by batch, to be dealt out.
    """

    def close(prints: list[np.ndarray], ids: list[np.ndarray]):
        fp, rep = np.concatenate(prints), np.concatenate(ids)
        i, j = bucket_links(fp.view(np.uint64), radius)
        return rep[i], rep[j]

    def run(batches):
        open_key, prints, ids, handing = None, [], [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(t)]))
            keep = (ends - starts > 1) | (starts == 0) | (ends == len(t))
            out = []
            if open_key is not None and (int(t[0]), int(key[0])) != open_key:
                if sum(map(len, prints)) > 1:
                    out.append(close(prints, ids))
                prints, ids, handing = [], [], False
            for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
                if s > 0:
                    prints, ids, handing = [], [], False
                prints.append(fp[s:e].copy())
                ids.append(rep[s:e].copy())
                if handing or sum(map(len, prints)) > most:
                    handing = True
                    for p, r in zip(prints, ids):
                        yield _emit(None, r, np.full(len(r), t[s]), np.full(len(r), key[s]), p)
                    prints, ids = [], []
                elif e < len(t):
                    if sum(map(len, prints)) > 1:
                        out.append(close(prints, ids))
                    prints, ids = [], []
            open_key = (int(t[-1]), int(key[-1]))
            if out:
                yield _emit(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))
        if sum(map(len, prints)) > 1:
            yield _emit(*close(prints, ids))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each whole text. A null text is empty, its print zero."""

    def run(batches):
        for batch in slices(batches):
            fp = [fingerprint(x, width) for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _link_tiles(radius: int):
    """Over rows (t, key, p, q, tile, fp, rep) sorted by the first four: links within a tile (p = q) or between two."""

    def run(batches):
        for table in groups(batches, 4):
            tile, fp, rep = (table.column(c).to_numpy() for c in ("tile", "fp", "rep"))
            i, j = bucket_links(fp.view(np.uint64), radius, None if table.column("p")[0] == table.column("q")[0] else tile == tile[0])
            yield pa.RecordBatch.from_arrays([pa.array(rep[i], pa.int64()), pa.array(rep[j], pa.int64())], ["a", "b"])

    return run


def _dealt(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """Links (a, b) of the rows (t, key, fp, rep) of large buckets, each pair of tiles of a bucket on its own.

    A print is sent once for each tile of its bucket: up to 64 of about half of `most`, more only where 64 would
    hold over 2^20 prints each.
    """
    n = F.col("n")
    tiles = F.greatest(F.least(F.lit(64), F.ceil(2 * n / most)), F.ceil(n / (1 << 20))).cast("int")
    sizes = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n")).select("t", "key", tiles.alias("tiles")))
    placed = lookup(rows, sizes, ["t", "key"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    each = each.select("t", "key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "fp", "rep")
    return each.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q").mapInArrow(_link_tiles(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, most: int = 8192) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in `radius` bits or fewer are linked; component_id is the smallest id
    reachable. Equal fingerprints are one node, so copies never meet in a bucket; of a bucket only
    spanning links leave. A bucket of more than `most` prints is dealt into pairs of tiles. Null and empty texts have fingerprint zero and are linked like others.
    Rows without an id keep their fingerprint and take the component of equal fingerprints with an
    id (null if there is none). Repeated rows are kept. Other columns of docs are ignored.
    """
    prints, nodes, links = _linked(docs, id_col, text_col, width, radius, most)
    roots = connected_components(links)
    by_print = nodes.join(roots, nodes.rep == roots.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, most: int = 8192) -> DataFrame:
    """(a, b): links of ids whose components are those of near_duplicates(), for callers that have more links to add."""
    prints, nodes, links = _linked(docs, id_col, text_col, width, radius, most)
    return links.unionByName(prints.join(nodes, "fp").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, fp) of all rows, (fp, rep) of the distinct fingerprints, and spanning links (a, b) between reps."""
    lean(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))])
    buckets = nodes.where("rep is not null").select(F.explode(tables).alias("x"), "fp", "rep").select("x.t", "x.key", "fp", "rep")
    found = cut(buckets.repartition(F.col("t"), F.col("key")).sortWithinPartitions("t", "key").mapInArrow(_link_buckets(radius, most), _LINKS))
    links, large = found.where("t is null").select("a", "b"), found.where("t is not null").select("t", "key", "fp", F.col("b").alias("rep"))
    if not large.isEmpty():
        links = links.unionByName(_dealt(large, radius, most))
    return prints, nodes, links


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all whole documents, by the contract's width and radius."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
