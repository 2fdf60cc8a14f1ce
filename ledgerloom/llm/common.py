"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words; bytes.split() without an argument parts at just these.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where none is set, a temporary one serves a driver that is
    its own executor; on a cluster that is an error, as executors could not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not known.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        at = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lean(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of about `most` bytes in this session, if it allows larger ones: they stand in the JVM's and in
    the worker's memory at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > most:
        spark.conf.set(name, f"{most}b")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and ends its lineage there."""
    spark = df.sparkSession
    at = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


#: Rows of a few longs that may be broadcast: tens of MB.
FEW = 1 << 20


def sent(few: DataFrame, rows: int = FEW) -> DataFrame:
    """A checkpoint or table of narrow rows, to be broadcast while it is counted to hold at most `rows` rows."""
    return F.broadcast(few) if few.count() <= rows else few


def lookup(df: DataFrame, few: DataFrame, on, how: str = "inner", rows: int = FEW) -> DataFrame:
    """df joined with a checkpoint or table of narrow rows: broadcast while it is counted to hold at most
    `rows` rows, else shuffled by the key."""
    return df.join(sent(few, rows), on, how)


def groups(batches, keys: int):
    """Arrow tables, one for each run of rows that agree in the first `keys` columns (integers); a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        other = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            other |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].item() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id, which so is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def _give_back() -> None:
    """Returns memory that a task before has freed to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, max_bytes: int = 16 << 20):
    """Cuts Arrow batches so that each holds about max_bytes at most (a single row may be longer)."""
    _give_back()
    for batch in batches:
        rows = batch.num_rows
        if batch.nbytes <= max_bytes or rows <= 1:
            if rows:
                yield batch
            continue
        sizes = np.zeros(rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list of longs: the smallest node reachable.

    Alternating large-star and small-star rounds; each round is one checkpoint, and rounds grow with
    the logarithm of the diameter. Self-loops and repeated edges are allowed; edges with a null end
    are ignored; no edges give no rows.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
