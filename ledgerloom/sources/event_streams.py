"""Growing text files of server-sent events as a data source, for batches and for streams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, stop long, line string, too_long boolean"
_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("line", pa.string()), ("too_long", pa.bool_())])


@dataclass
class Stretch(InputPartition):
    """Bytes of a file: those lines are of it whose newline lies from start to before end."""

    path: str
    start: int
    end: int


def _store(folder: str):
    """The file system and path of an address; local ones may be spelled file:/x."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


def _sizes(folder: str) -> dict[str, int]:
    """Bytes of each file of a folder, at any depth; names that begin with a dot or underscore are others' business."""
    store, at = _store(folder)
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return {x.path: x.size for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))}


def _stretches(start: dict[str, int], end: dict[str, int], most: int) -> list[Stretch]:
    return [Stretch(path, at, min(at + most, to)) for path, to in sorted(end.items()) for at in range(start.get(path, 0), to, most)]


class _Lines:
    """Reads stretches; a line's beginning may lie before its stretch, at most line_limit bytes of it are looked for."""

    def __init__(self, options):
        self.folder = options["path"]
        self.line_limit = int(options.get("linelimit", 1 << 20))
        self.stream_limit = int(options.get("streamlimit", 16 << 20))
        self.most = int(options.get("stretch", 8 << 20))

    def lines(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        with store.open_input_file(part.path) as f:
            before = max(0, part.start - self.line_limit - 1)
            f.seek(before)
            data = f.read(part.end - before)
        # The line that is open where the stretch begins: from after the last newline before it, if that is near enough.
        begin = data.rfind(b"\n", 0, part.start - before) + 1
        cut_off = begin == 0 and before > 0
        rows, held = [], 0
        at = data.find(b"\n", part.start - before)
        while at >= 0:
            size = at - begin
            long = cut_off or size > self.line_limit
            stop = before + at + 1
            body = b"" if long else data[begin:at]
            rows.append((part.path, before + begin if not cut_off else None, stop, body.decode("utf-8", "replace"), long or stop > self.stream_limit))
            held += len(body) + 50
            begin, cut_off = at + 1, False
            at = data.find(b"\n", begin)
            if held > 1 << 20 or at < 0:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
                rows, held = [], 0


class _Batch(_Lines, DataSourceReader):
    def partitions(self):
        return _stretches({}, _sizes(self.folder), self.most)

    def read(self, partition):
        return self.lines(partition)


class _Stream(_Lines, DataSourceStreamReader):
    """The offset is how far each file is planned. Files only grow; one that is gone is no longer read."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _sizes(self.folder)

    def partitions(self, start: dict, end: dict):
        return _stretches(start, end, self.most)

    def read(self, partition):
        return self.lines(partition)


class EventLines(DataSource):
    """Format `event_lines`: the complete lines of text files, each once, however the files grow meanwhile.

    Options: path, a folder; lineLimit, streamLimit: bytes of a line and of a file up to the line, beyond which a line is
    too_long (a line over its own limit is not told); stretch: bytes of a file that a task reads. A line belongs to where its newline
    is, so a line that isn't finished comes once it is, and a file may be many tasks' work. Rows: path, start and stop (bytes of the line with its
    newline; start is null where it lies further back than a line may be long), line, too_long. Lines are UTF-8, with replacements.
    """

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLines)


def payload(line: str = "line") -> Column:
    """What a `data: ` line carries; null for other lines."""
    return F.when(F.col(line).startswith("data: "), F.substring(F.col(line), F.lit(7), F.length(line)))


def before_end(lines: DataFrame) -> DataFrame:
    """Lines of each file before its end mark, `data: [DONE]`: a small minimum for each file, then a join."""
    ends = lines.where(F.trim("line") == "data: [DONE]").groupBy("path").agg(F.min("start").alias("_end"))
    return lines.join(ends, "path", "left").where(F.col("_end").isNull() | (F.col("start") < F.col("_end"))).drop("_end")
