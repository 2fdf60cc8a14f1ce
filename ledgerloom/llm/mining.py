"""Hard-negative mining: products along an orthogonal PCA rotation, bounded early, survivors as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean

#: Vectors of anchors that travel together, and of rows that one unit of work streams.
TILE_BYTES, LANE_BYTES, LANES = 8 << 20, 64 << 20, 32
#: Anchors and rows that are multiplied at once; a share of live pairs above MANY calls for the next components.
STEP, MANY = 1024, 0.01
#: Longest vector of integers that takes part: a hundred times any score then fits a long.
LONGEST = 1 << 28
NONE = -(1 << 62)


def _blobs(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, width)


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _integers(scale: int):
    """(id, label, anchor, dims, v): floor(scale * x) of each component; vectors longer than LONGEST go."""

    def run(batches):
        for batch in batches:
            e = batch.column(3)
            sizes = e.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            kept, raw = [], []
            with np.errstate(over="ignore"):
                flat = np.floor(scale * e.flatten().to_numpy(zero_copy_only=False))
                for k, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                    part = flat[end - n : end]
                    if part @ part <= float(LONGEST) ** 2:
                        kept.append(k)
                        raw.append(part.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept, pa.int64())) for c in range(3)), pa.array(sizes[kept], pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "anchor", "dims", "v"])

    return run


def _moments(batches):
    """Sums of outer products by number of dimensions, of one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        all_dims = batch.column("dims").to_numpy()
        for d in np.unique(all_dims).tolist():
            x = _blobs(batch.filter(pa.array(all_dims == d)), "v", "<i4", d).astype(np.float64)
            sums[d] = sums.get(d, 0) + x.T @ x
    part = TaskContext.get().partitionId() % 1024
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["dims", "part", "m"])


def _total(table: pa.Table) -> np.ndarray:
    d = table.column("dims")[0].as_py()
    total = np.zeros((d, d))
    for m in table.column("m"):
        total += np.frombuffer(m.as_buffer(), np.float64).reshape(d, d)
    return total


def _add(table: pa.Table) -> pa.Table:
    return table.slice(0, 1).set_column(2, "m", pa.array([_total(table).tobytes()], pa.binary()))


def _rotation(table: pa.Table) -> pa.Table:
    """Eigenvectors of the summed moments, the largest first."""
    total = _total(table)
    q = np.linalg.eigh(total / max(1.0, np.abs(total).max(initial=0)))[1][:, ::-1]
    return pa.table({"dims": table.column("dims").slice(0, 1), "q": pa.array([np.ascontiguousarray(q).tobytes()], pa.binary())})


def rotations(rows: DataFrame) -> DataFrame:
    """(dims, q): the orthogonal PCA rotation of all rows with so many dimensions; sums of all tasks, added up in two steps."""
    sums = rows.select("dims", "v").mapInArrow(_moments, "dims int, part int, m binary")
    sums = sums.groupBy("dims", "part").applyInArrow(_add, "dims int, part int, m binary")
    return sums.groupBy("dims").applyInArrow(_rotation, "dims int, q binary")


class Side:
    """Integer vectors, their leading components in two groups, and the lengths of what each group leaves."""

    def __init__(self, x: np.ndarray, q: np.ndarray, step: int = 0):
        d = x.shape[1]
        wide = x.astype(np.float64)
        z = wide @ q
        first, second = (max(1, d // 4), max(1, d // 2)) if d else (0, 0)
        self.x = x
        self.lead = [z[:, :first].astype(np.float32), z[:, first:second].astype(np.float32)]
        self.rest = [(np.sqrt((z[:, k:] ** 2).sum(1)) * (1 + 1e-6)).astype(np.float32) for k in (first, second)]
        self.norm = np.sqrt((wide * wide).sum(1)).astype(np.float32)


def slack(q: np.ndarray) -> np.float32:
    """Of |x| |y|, how far single-precision partial products and a rotation that isn't quite orthogonal can err."""
    d = len(q)
    off = np.sqrt(((q.T @ q - np.eye(d)) ** 2).sum())
    return np.float32((2 * d + 32) * 2.0**-24 + 2 * off + d * d * 2.0**-50)


class Best:
    """The first k (score falling, id rising) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.full((slots, k), NONE, np.int64), np.full((slots, k), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        touched = np.unique(slot)
        slot = np.concatenate((np.repeat(touched, self.k), slot))
        score = np.concatenate((self.score[touched].ravel(), score))
        ident = np.concatenate((self.id[touched].ravel(), ident))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        nth = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        on = nth < self.k
        self.score[slot[on], nth[on]], self.id[slot[on], nth[on]] = score[on], ident[on]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf where there are fewer."""
    return np.partition(x, -k, axis=1)[:, -k] if x.shape[1] >= k else np.full(len(x), -np.inf, np.float32)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


class Unit:
    """A tile of anchors, against the rows of a lane as they stream by.

    Without windows, the first k rows of an anchor's own label, itself excepted. With windows (low, high), the first k rows of other
    labels whose score lies in a window, for each window of an anchor.
    """

    def __init__(self, q: np.ndarray, x: np.ndarray, keys: np.ndarray, labels: np.ndarray, k: int, windows: tuple[np.ndarray, np.ndarray] | None = None):
        order = np.argsort(labels, kind="stable")
        self.q, self.k, self.keys, self.labels = q, k, keys[order], labels[order]
        self.a, self.slack = Side(x[order], q), slack(q)
        self.low, self.high = (w[order] for w in windows) if windows else (np.full((len(x), 1), NONE), np.full((len(x), 1), -NONE))
        self.own = windows is None
        self.best = Best(self.low.size, k)
        self.least = _down(self.low)  # no pair below it can be among the first k any more
        self.least[self.low > self.high] = np.inf
        self.verified = 0

    def rows(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), STEP):
            part = slice(at, at + STEP)
            self._block(ids[part], keys[part], labels[part], Side(x[part], self.q))

    def _block(self, ids, keys, labels, b: Side) -> None:
        for at in range(0, len(self.keys), STEP):
            if not self.own:
                self._pairs(slice(at, at + STEP), np.arange(len(ids)), ids, keys, labels, b)
        if self.own:
            for label in np.unique(labels).tolist():
                start, end = np.searchsorted(self.labels, [label, label + 1])
                for at in range(start, end, STEP):
                    self._pairs(slice(at, min(at + STEP, end)), np.flatnonzero(labels == label), ids, keys, labels, b)

    def _pairs(self, a: slice, to: np.ndarray, ids, keys, labels, b: Side) -> None:
        least, high = self.least[a], self.high[a]
        low_high, high_up = _down(high), _up(high)
        product, out = 0, self.keys[a][:, None] == keys[to][None, :] if self.own else self.labels[a][:, None] == labels[to][None, :]
        live = None
        for step in (0, 1):
            product = product + self.a.lead[step][a] @ b.lead[step][to].T
            product[out] = -np.inf
            width = np.outer(self.a.rest[step][a], b.rest[step][to]) + self.slack * np.outer(self.a.norm[a], b.norm[to])
            most, fewest = product + width, product - width
            live = self._live(most, fewest, least, high_up)
            if live.mean() <= MANY:
                break
            # k rows are known to score at least so much, and not above the window.
            for w in range(least.shape[1]):
                least[:, w] = np.maximum(least[:, w], _down(_kth(fewest if self.own else np.where(most <= low_high[:, w : w + 1], fewest, -np.inf), self.k)))
            live = self._live(most, fewest, least, high_up)
            if live.mean() <= MANY:
                break
        i, j = np.nonzero(live)
        self.verified += len(i)
        i, j = i + a.start, to[j]
        for at in range(0, len(i), 8192):
            p, r = i[at : at + 8192], j[at : at + 8192]
            score = np.einsum("ij,ij->i", self.a.x[p].astype(np.int64), b.x[r].astype(np.int64))
            for w in range(least.shape[1]):
                on = (score >= self.low[p, w]) & (score <= self.high[p, w])
                if on.any():
                    self.best.add(p[on] * least.shape[1] + w, score[on], ids[r[on]])
        last = self.best.score[:, -1].reshape(self.least.shape)[a]
        self.least[a] = np.maximum(least, _down(last))

    def _live(self, most, fewest, least, high) -> np.ndarray:
        live = np.zeros(most.shape, bool)
        for w in range(least.shape[1]):
            live |= (most >= least[:, w : w + 1]) & (fewest <= high[:, w : w + 1])
        return live

    def found(self) -> pa.RecordBatch:
        slot, nth = np.nonzero(self.best.score > NONE)
        windows = self.low.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(self.keys[slot // windows]), pa.array(slot % windows, pa.int32()), pa.array(self.best.score[slot, nth]), pa.array(self.best.id[slot, nth])], ["anchor", "window", "score", "id"])


def _scan(k: int, percent: tuple[int, int] | None):
    """Streams units (dims, tile, lane): first the rotation, then the tile's anchors, then the lane's rows."""

    def start(q, held, dims):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        windows = None
        if percent:
            scores = batch.column("scores").to_pylist()
            n = max(map(len, scores))
            s = np.array([x + [-1] * (n - len(x)) for x in scores], np.int64)  # a negative score has no window
            windows = (np.where(s < 0, 1, -(-percent[0] * s // 100)), np.where(s < 0, 0, percent[1] * s // 100))
        return Unit(q, _blobs(batch, "v", "<i4", dims), _longs(batch, "key"), _longs(batch, "label"), k, windows)

    def run(batches):
        unit, q, held, last = None, None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("dims", "tile", "lane", "kind")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                dims, tile, lane, kind = (int(c[a]) for c in columns)
                if (dims, tile, lane) != last:
                    if unit is not None:
                        yield unit.found()
                    unit, q, held, last = None, None, [], (dims, tile, lane)
                part = batch.slice(a, b - a)
                if kind == 0:
                    q = np.frombuffer(part.column("v")[0].as_py(), np.float64).reshape(dims, dims)
                elif kind == 1:
                    held.append(part)
                elif held:  # no anchor of so many dimensions: nothing to find
                    unit = unit or start(q, held, dims)
                    unit.rows(_longs(part, "id"), _longs(part, "key"), _longs(part, "label"), _blobs(part, "v", "<i4", dims))
        if unit is not None:
            yield unit.found()

    return run


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), and a score is the integer inner product with the anchor; higher ones come
    first, ties by the smaller id. An anchor's positives are its first other rows of the same label; for each, the
    first rows of other labels whose score is from percent[0] to percent[1] of the positive's are its negatives, ranked from 1.

    Rows without an id or a label, with a null vector, or a null or non-finite component take no part, nor do vectors
    longer than LONGEST as integers (their scores need not fit a long). Rows that repeat an id or are equal are rows
    of their own. Vectors only meet vectors of as many dimensions; those without components score 0. No rows and no anchors give no rows.

    All vectors are rotated by the eigenvectors of their moments. A pair's partial product over the leading quarter and
    half of the components is off by at most the product of what the two vectors have left, and rounding. Pairs that so can't be among the
    first are discarded, all others multiplied as integers. Anchors travel in tiles to lanes of rows: a row moves once
    for each tile of anchors, and a unit holds a tile, its lists and a block of rows. Lists merge by anchor, a few entries a lane.
    """
    lean(vectors.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("e"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("e", finite), F.lit(False)))
    rows = cut(clean.mapInArrow(_integers(scale), "id long, label long, anchor boolean, dims int, v binary")).withColumn("key", F.monotonically_increasing_id())
    size = F.sum(F.octet_length("v").cast("long"))
    total, of_anchors = rows.agg(size, F.sum(F.when(F.col("anchor"), F.octet_length("v").cast("long")))).first()
    tiles, lanes = max(1, -(-(of_anchors or 0) // TILE_BYTES)), max(LANES, -(-(total or 0) // LANE_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    turned = cut(rotations(rows))
    columns = ["dims", "tile", "lane", "kind", "key", "id", "label", "v", "scores"]
    none = F.lit(None).cast("array<long>")
    zero = F.lit(0).cast("long")
    of_rows = rows.select("dims", every(tiles).alias("tile"), F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int").alias("lane"), F.lit(2).alias("kind"), "key", "id", "label", "v", none.alias("scores"))
    of_turns = turned.select("dims", every(tiles).alias("tile"), "q").select("dims", "tile", every(lanes).alias("lane"), F.lit(0).alias("kind"), zero.alias("key"), zero.alias("id"), zero.alias("label"), F.col("q").alias("v"), none.alias("scores"))

    def scanned(anchors: DataFrame, k: int, percent) -> DataFrame:
        tiled = anchors.select("*", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(tiles)).cast("int").alias("tile"))
        tiled = tiled.select("dims", "tile", every(lanes).alias("lane"), F.lit(1).alias("kind"), "key", "id", "label", "v", "scores")
        units = of_turns.unionByName(tiled).unionByName(of_rows).select(*columns)
        units = units.repartition("dims", "tile", "lane").sortWithinPartitions("dims", "tile", "lane", "kind")
        found = units.mapInArrow(_scan(k, percent), "anchor long, window int, score long, id long")
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where("anchor")
    first = cut(scanned(anchors.withColumn("scores", none), positives, None).select("anchor", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    lists = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    known = anchors.join(lists, F.col("key") == lists["anchor"]).select("dims", "key", "id", "label", "v", "scores")
    second = scanned(known, negatives, percent).select("anchor", (F.col("window") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = first.join(anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(second, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_rotated_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh has its label moved on."""
    label = F.col("label").cast("long")
    moved = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(moved, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.k <> b.k AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""
