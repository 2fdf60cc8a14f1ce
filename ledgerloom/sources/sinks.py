"""Writers: staged publication with an audit before the rename, append-only ledgers."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import parsed
from .files import numbered_lines


class Exists(FileExistsError):
    """A publication never overwrites."""


class Folder:
    """Control files and renames on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.at)

    def remove(self) -> None:
        self.fs.delete(self.at, True)

    def rename(self, to: str) -> None:
        if not self.fs.rename(self.at, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{self.at} was not renamed to {to}")

    def put(self, name: str, text: str) -> None:
        out = self.fs.create(self.jvm.org.apache.hadoop.fs.Path(self.at, name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def publish(rows: DataFrame, path: str, split: str = "split", position: str = "position", line: str = "row", more: dict | None = None) -> dict:
    """Writes the lines of each split in the order of their positions, with a manifest, then reads all again.

    Ranges of positions are written in parallel, into files whose names sort as the lines do. Positions count
    from zero in each split, and split names are plain words. The folder appears under its name only after counts and hashes of what was read agree with the
    rows; a folder that is there already is never replaced. Returns the manifest.
    """
    spark = rows.sparkSession
    target = Folder(spark, path)
    if target.exists():
        raise Exists(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    stage = Folder(spark, staged)
    try:
        ordered = rows.select(split, position, line).repartitionByRange(split, position).sortWithinPartitions(split, position)
        ordered.select(split, line).write.partitionBy(split).text(staged)
        # Counts and sums of hashes of (position, line): no split's rows are gathered, and order counts.
        h = F.xxhash64(F.col(position).cast("long"), line)
        sums = (F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("xor"))
        print_of = lambda df: {r[split]: (r["n"], f"{r['total']}:{r['xor']}") for r in df.groupBy(split).agg(*sums).collect()}
        want, got = print_of(rows), print_of(published(spark, staged, split, position, line))
        if want != got:
            raise ValueError("what was written differs from the rows, or positions do not count from zero")
        manifest = {"schema": "training-dataset-v1", "files": {k: {"rows": n, "rows_hash": h} for k, (n, h) in sorted(want.items())}} | (more or {})
        stage.put("manifest.json", json.dumps(manifest, sort_keys=True))
        stage.rename(path)
    except BaseException:
        stage.remove()
        raise
    return manifest


def published(spark: SparkSession, path: str, split: str, position: str, line: str) -> DataFrame:
    """Lines of a partitioned text folder, numbered through each split's files in the order of their names."""
    lines = numbered_lines(spark, path).withColumn(split, F.regexp_extract("path", f"/{split}=([^/]*)/[^/]*$", 1))
    counts = lines.groupBy(split, "path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(split).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = lines.join(counts.select("path", before.alias("_before")), "path")
    return both.select(split, (F.col("_before") + F.col("position")).alias(position), F.col("value").alias(line))


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds rows to a ledger; rows are never changed."""
    rows.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def ordered_lines(rows: DataFrame, path: str, position: str, line: str) -> None:
    """Lines in order, in files whose names sort alike; ranges of positions are written in parallel."""
    rows.repartitionByRange(position).sortWithinPartitions(position).select(line).write.text(path)


def publish_once(rows: DataFrame, path: str, texts: dict[str, str], manifest: dict, columns: list[str]) -> dict:
    """Writes rows as JSON lines, and texts beside them, into a folder that may not be there yet.

    Rows are read back and compared by count and sum of hashes; the manifest binds them and each text by its
    hash and is put last, before the folder gets its name.
    """
    spark = rows.sparkSession
    target = Folder(spark, path)
    if target.exists():
        raise Exists(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    stage = Folder(spark, staged)
    sums = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())
    try:
        rows.select(*columns).write.json(f"{staged}/rows")
        want, got = sums(rows), sums(spark.read.schema(rows.select(*columns).schema).json(f"{staged}/rows"))
        if want != got:
            raise ValueError("what was written differs from the rows")
        for name, text in texts.items():
            stage.put(name, text)
        told = manifest | {"rows": got[0], "rows_hash": str(got[1]), "files": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(texts.items())}}
        stage.put("manifest.json", json.dumps(told, sort_keys=True))
        stage.rename(path)
    except BaseException:
        stage.remove()
        raise
    return told


def snapshot(spark: SparkSession, texts: dict[str, str], path: str) -> list[dict]:
    """Keeps texts in files of a folder, once: a file that is there is never replaced. Returns path and sha256 of each."""
    at = Folder(spark, path)
    for name in texts:
        if Folder(spark, f"{path}/{name}").exists():
            raise Exists(f"{path}/{name}")
    for name, text in texts.items():
        at.put(name, text)
    return [{"path": name, "sha256": hashlib.sha256(text.encode()).hexdigest()} for name, text in sorted(texts.items())]


def put_version(spark: SparkSession, path: str, text: str) -> int:
    """Adds a text to a control file as its next version, and returns the version's number.

    A version is a file of its own that is created only if it isn't there, so writers never overwrite each other, on any store that can do as
    much, and nothing is renamed or removed. It begins with the hash of what follows, by which a reader tells one that was left unfinished.
    """
    at = Folder(spark, path)
    at.fs.mkdirs(at.at)
    told = f"{hashlib.sha256(text.encode()).hexdigest()}\n{text}"
    number = max(_versions(at), default=0)
    while True:
        number += 1
        try:
            at.put(f"v{number:012d}", told)
            return number
        except Exception as e:  # another writer was first: the next number
            if "AlreadyExists" not in str(e):
                raise


def _versions(at: Folder) -> list[int]:
    """Numbers of the versions that are there."""
    if not at.exists():
        return []
    names = [x.getPath().getName() for x in at.fs.listStatus(at.at)]
    return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]


def newest_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and text of the newest complete version of a control file; None if there is none. Unfinished ones are passed over."""
    at = Folder(spark, path)
    for number in sorted(_versions(at), reverse=True):
        rows = spark.read.format("binaryFile").load(f"{path}/v{number:012d}").select("content").collect()  # one small file
        sha, _, body = (bytes(rows[0].content) if rows else b"").partition(b"\n")
        if hashlib.sha256(body).hexdigest().encode() == sha:
            return number, body.decode()
    return None


def write_report(report: DataFrame, path: str) -> dict:
    """Adds a one-row report as the next version of a control file, and returns it; newest_version() reads it."""
    row = report.first().asDict(recursive=True)
    put_version(report.sparkSession, path, json.dumps(row, sort_keys=True, default=str))
    return row


def event_lines(events: DataFrame, prefix: str, column: str = "event") -> DataFrame:
    """`line`: the prefix and each event's JSON with sorted keys; events that are no strict JSON give null."""
    return events.select("*", F.concat(F.lit(prefix), parsed(F.col(column), "binding")["canonical"]).alias("line"))
