"""Writers, readers and chains that end in files, on literal cases."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import datasets as D
from ledgerloom.operators import rules as R
from ledgerloom.sources import files as S
from ledgerloom.sources import sinks as K


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "f").mkdir()
    want = {}
    for name in ("a", "b"):
        lines = [f"{name}{i} " + "x" * (i % 50) for i in range(900)]
        want[name] = lines
        (tmp_path / "f" / f"{name}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = S.numbered_lines(spark, f"file://{tmp_path}/f").collect()
        assert len({r.path for r in rows}) == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in want.items():
        got = sorted((r.position, r.value) for r in rows if r.path.endswith(f"{name}.txt"))
        assert got == list(enumerate(lines))


def test_manifest(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.jsonl").write_bytes(b'{"a":1}\n{\n')
    (tmp_path / "m" / "b.jsonl").write_bytes(b'{"a":1}\n')
    read, have = S.json_lines(spark, f"file://{tmp_path}/m"), S.inventory(spark, f"file://{tmp_path}/m")
    plain = F.regexp_extract("path", "([^/]*)$", 1)
    read, have = read.withColumn("path", plain), have.withColumn("path", plain)
    sha = lambda n: hashlib.sha256((tmp_path / "m" / n).read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("a.jsonl", sha("a.jsonl"), 2), ("c.jsonl", "x", 1)], "path string, sha256 string, rows long")
    assert sorted(map(tuple, S.manifest_problems(read, have, manifest).collect())) == [("a.jsonl", "not_json"), ("b.jsonl", "not_in_manifest"), ("c.jsonl", "missing")]
    wrong = spark.createDataFrame([("a.jsonl", "x", 3), ("b.jsonl", sha("b.jsonl"), 1)], "path string, sha256 string, rows long")
    assert sorted(map(tuple, S.manifest_problems(read, have, wrong).collect())) == [("a.jsonl", "hash_differs"), ("a.jsonl", "not_json"), ("a.jsonl", "rows_differ")]


def test_positions_that_do_not_count_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("training", i, f"r{i}") for i in (0, 1, 3)], "split string, position int, row string")
    with pytest.raises(ValueError):
        K.publish(df, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_publish_test_dataset(spark, tmp_path):
    rows = spark.createDataFrame([("test", i, f'{{"i": {i}}}') for i in range(5)], "split string, position int, row string")
    none = spark.createDataFrame([], "id string, rule string")
    manifest = D.publish_test(rows, f"{tmp_path}/t", none, {"review": "r", "approval": "é"})
    assert manifest["schema"] == "test-dataset-v1" and manifest["acceptance"]["approval"] == {"content": "é", "sha256": hashlib.sha256("é".encode()).hexdigest()}
    assert json.loads((tmp_path / "t" / "manifest.json").read_text()) == manifest
    with pytest.raises(R.Violated):
        D.publish_test(rows, f"{tmp_path}/u", spark.createDataFrame([("p", "x")], "id string, rule string"), {})
    with pytest.raises(K.Exists):
        D.publish_test(rows, f"{tmp_path}/t", none, {})


def test_reports_are_versions(spark, tmp_path):
    at = f"{tmp_path}/r"
    assert K.newest_version(spark, at) is None
    for n in (1, 2):
        K.write_report(spark.createDataFrame([(n, None)], "targets int, exact int"), at)
    number, text = K.newest_version(spark, at)
    assert number == 2 and json.loads(text) == {"exact": None, "targets": 2}


@pytest.mark.parametrize("left", [b"", b"\n", b"x", b"0" * 64 + b"\n{", b"\xff\xfe"])
def test_an_unfinished_version_is_passed_over(spark, tmp_path, left):
    at = tmp_path / "c"
    K.put_version(spark, str(at), "one")
    (at / "v000000000002").write_bytes(left)
    (at / "other").write_text("x")
    assert K.newest_version(spark, str(at)) == (1, "one")
    assert K.put_version(spark, str(at), "") == 3 and K.newest_version(spark, str(at)) == (3, "")


def test_writers_never_overwrite_each_other(spark, tmp_path, monkeypatch):
    """Two writers that see the same versions take different numbers."""
    K.put_version(spark, str(tmp_path / "c"), "first")
    monkeypatch.setattr(K, "_versions", lambda at: [])
    assert K.put_version(spark, str(tmp_path / "c"), "second") == 2
    monkeypatch.undo()
    assert K.newest_version(spark, str(tmp_path / "c")) == (2, "second")


def test_projections(spark):
    packets = spark.createDataFrame([("p", "a", "v", "w", "t", 1)], "packet_id string, accession string, packet_version string, view_version string, target_id string, blocks int")
    assert D.recovered(packets).columns == ["packet_id", "accession"]
    cases = spark.createDataFrame([(1, "ref", ["c"], ["m"])], "id int, reference string, cells array<string>, messages array<string>")
    assert D.session_requests(cases).columns == ["id", "messages"]


def test_chunks_are_framed(spark):
    df = spark.createDataFrame([("f", 1, "b\r\nccc"), ("f", 0, "a"), ("f", 2, "cc\n\n"), ("g", 0, "x" * 7)], "path string, position int, value string")
    got = sorted(map(tuple, S.framed_lines(df, limit=4).collect()))
    assert got == [("f", 0, "ab"), ("f", 1, "cccc"), ("f", 2, "c"), ("f", 3, ""), ("g", 0, "xxxx"), ("g", 1, "xxx")]
