"""Complete lines of growing files, each once, and chunks framed without putting a key together."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import scan
from ledgerloom.sources import event_streams as E
from ledgerloom.sources import files as S
from ledgerloom.streaming import events


def expected(path, data, line_limit=1 << 20, stream_limit=16 << 20):
    out, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        long = end - at > line_limit
        out.append((path, end + 1, "" if long else data[at:end].decode("utf-8", "replace"), long or end + 1 > stream_limit))
        at = end + 1
    return out


def rows(df):
    return sorted((r.path.rsplit("/", 1)[1], r.stop, r.line, r.too_long) for r in df.collect())


@pytest.mark.parametrize("stretch,line_limit", [(1, 5), (3, 5), (7, 40), (1 << 20, 1 << 20)])
def test_batches_read_every_line_once(spark, tmp_path, stretch, line_limit):
    rng = random.Random(stretch)
    data = {f"f{k}": b"".join(rng.choice([b"data: x", b"\n", "é😀".encode(), b"\xff", b"\r\n", b"a" * 30]) for _ in range(rng.randrange(0, 60))) for k in range(4)} | {"empty": b"", "_hidden": b"x\n"}
    for name, text in data.items():
        (tmp_path / name).write_bytes(text)
    E.register(spark)
    found = spark.read.format("event_lines").option("stretch", stretch).option("lineLimit", line_limit).option("streamLimit", 100).load(f"file:{tmp_path}")
    assert rows(found) == sorted(x for name, text in data.items() if name[0] != "_" for x in expected(name, text, line_limit, 100))
    near = found.where("start is not null and not too_long").collect()
    assert all(data[r.path.rsplit("/", 1)[1]][r.start : r.stop - 1].decode("utf-8", "replace") == r.line for r in near)


def test_a_restarted_stream_loses_and_doubles_nothing(spark, tmp_path):
    E.register(spark)
    folder, at = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def run():
        read = spark.readStream.format("event_lines").option("stretch", 9).load(str(folder))
        events.run_to_end(read, events.append_to(str(at / "rows")), str(at / "checkpoint"), "append")
        return rows(events.committed(spark, str(at / "rows")))

    (folder / "a").write_bytes(b"data: 1\ndata: 2\nda")
    assert run() == expected("a", b"data: 1\ndata: 2\n")
    with (folder / "a").open("ab") as f:
        f.write(b"ta: 3\ndata: [DO")
    (folder / "b").write_bytes(b": ping\n")
    assert run() == sorted(expected("a", b"data: 1\ndata: 2\ndata: 3\n") + expected("b", b": ping\n"))
    assert run() == run()
    with (folder / "a").open("ab") as f:
        f.write(b"NE]\ndata: after\n")
    found = run()
    assert found == sorted(expected("a", b"data: 1\ndata: 2\ndata: 3\ndata: [DONE]\ndata: after\n") + expected("b", b": ping\n"))
    before = E.before_end(events.committed(spark, str(at / "rows"))).select(E.payload().alias("p")).where("p is not null")
    assert sorted(r.p for r in before.collect()) == ["1", "2", "3"]


@pytest.mark.parametrize("hot", [1 << 20, 5])
def test_framing_against_whole_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(scan, "HOT", hot)
    rng = random.Random(hot)
    chunks = [(k, i, "".join(rng.choices(["a", "b\r", "\n", "\r\n", "", "é", "xyz" * 4], k=rng.randrange(0, 7)))) for k in range(12) for i in range(rng.randrange(0, 9))] + [(50, 1, None), (51, 0, "\n"), (52, 3, "aaaa"), (52, 4, "\n"), (53, 0, "aaaa"), (53, 1, "")]
    want = []
    for key in {k for k, *_ in chunks}:
        text = "".join(t or "" for k, _, t in chunks if k == key)
        lines = text.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        pieces = [line[i * 4 : i * 4 + 4].rstrip("\r") for line in lines for i in range(max(0, (len(line) - 1) // 4) + 1)]
        want += [(key, n, p) for n, p in enumerate(pieces)]
    df = spark.createDataFrame(chunks, "path int, position int, value string").repartition(4)
    assert sorted(map(tuple, S.framed_lines(df, limit=4).collect())) == sorted(want)


def test_a_line_over_all_chunks_is_never_one_row(spark):
    chunks = spark.range(500).select(F.lit("k").alias("path"), F.col("id").alias("position"), F.repeat(F.lit("abc"), 11).alias("value"))
    found = S.framed_lines(chunks, limit=100)
    assert found.agg(F.max(F.length("value")), F.count("*"), F.sum(F.length("value"))).first() == (100, 165, 16500)
