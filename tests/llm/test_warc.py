import hashlib
import os
import random

import pytest

from ledgerloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, refers_to string"


def pages():
    big = "x" * 150
    return [
        (5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (9, None, big), (1, "http://a/\r\nX: y", "short"), (3, "http://a/3", "short"),
        (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "WARC/1.1\r\n" * 30), (11, "u", os.urandom(9 << 20).hex()),
        (2, "http://a/2", big), (12, "u", "\r\n\r\n\x00\x1f"),
    ]


def want(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "") == (html or "")]
        again = len(body) >= 100 and page is not None and page != min(same)
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = pages()
    W.write(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3), f"file://{tmp_path}/w", per_file=4)
    found = W.read(spark, f"file://{tmp_path}/w", payloads=True).collect()
    assert not [r for r in found if r.gap]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == want(rows)
    assert {r.page_id: bytes(r.payload).decode() for r in found if r.page_id in (7, 11, 12)} == {p: h for p, _, h in rows if p in (7, 11, 12)}
    assert all(f.endswith((".txt", ".crc", "_SUCCESS")) for f in os.listdir(tmp_path / "w"))


def archive(packed, n=6):
    parts = []
    for i in range(n):
        body = (f"page {i} " * (40 + i)).encode()
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest())]
        record = W.build(headers, b"HTTP/1.1 200 OK\r\n\r\n" + body)
        parts.append(W.member(record) if packed else record)
    return parts


def ids(found):
    return [W._page(x.headers["warc-record-id"]) for x in found if isinstance(x, W.Record)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts = archive(packed)
    assert ids(W.salvage(b"".join(parts))) == list(range(6))
    at = len(parts[0]) + len(parts[1]) // 2
    data = bytearray(b"".join(parts))
    data[at] ^= 0x55
    found = list(W.salvage(bytes(data)))
    gaps = [x for x in found if isinstance(x, W.Gap)]
    assert ids(found) == [0, 2, 3, 4, 5] and [(g.start, g.end) for g in gaps] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
    cut = b"junk" + b"".join(parts)[: -len(parts[5]) // 2]
    found = list(W.salvage(cut))
    assert ids(found) == [0, 1, 2, 3, 4] and len([x for x in found if isinstance(x, W.Gap)]) == 2
    assert ids(W.salvage(parts[0] + b"\x1f\x8b\x08\x00garbage WARC/1.1\r\nno" + parts[1])) == [0, 1]
    assert list(W.salvage(b"")) == [] and [type(x) for x in W.salvage(b"WARC/1.0\r\n")] == [W.Gap]


@pytest.mark.parametrize("packed", [True, False])
def test_every_byte_of_the_archive_is_a_record_or_a_gap(packed):
    rng = random.Random(3)
    for _ in range(60):
        data = bytearray(b"".join(archive(packed)))
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if rng.random() < 0.5:
            at = rng.randrange(len(data))
            del data[at : at + rng.randrange(900)]
        pos = 0
        for x in W.salvage(bytes(data)):
            assert x.start == pos and x.end > pos
            pos = x.end
        assert pos == len(data)


def test_empty_table(spark, tmp_path):
    W.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert W.read(spark, f"file://{tmp_path}/w").collect() == []


def test_headers_of_any_length():
    url = "http://a/" + "u" * (3 << 20)
    record = W.build([("WARC-Type", "response"), ("WARC-Target-URI", url)], b"block")
    for archive in (record * 2, W.member(record) * 2):
        found = list(W.salvage(archive))
        assert len(found) == 2 and all(isinstance(x, W.Record) and x.headers["warc-target-uri"] == url for x in found)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", os.urandom(100_000).hex()) for i in range(60)]
    W.write(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).coalesce(1), f"file://{tmp_path}/w", per_file=2, chunk=250_000)
    sizes = [os.path.getsize(tmp_path / "w" / f) for f in os.listdir(tmp_path / "w") if f.endswith(".txt")]
    assert len(sizes) > 8 and max(sizes) < 2 * (250_000 + 110_000)
    assert sorted(r.page_id for r in W.read(spark, f"file://{tmp_path}/w").collect()) == list(range(60))


def test_many_false_version_lines_take_linear_time():
    import time

    good = archive(False)[0]
    took = []
    for n in (20_000, 80_000):
        data = b"WARC/1.1\r\nA: b\r\n" * n + good
        began = time.perf_counter()
        assert ids(W.salvage(data)) == [0]
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5
    began = time.perf_counter()
    assert ids(W.salvage(b"WARC/1.1\r\n" * 500_000)) == [] and time.perf_counter() - began < 30


def test_gaps_are_no_silent_loss(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k}" * 20) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    W.write(pages, f"file://{tmp_path}/w")
    assert W.whole(W.read(spark, f"file://{tmp_path}/w")).count() == 20
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    held = bytearray(part.read_bytes())
    held[len(held) // 2] ^= 0xFF
    part.write_bytes(held)
    (tmp_path / "w" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="unreadable bytes in"):
        W.whole(W.read(spark, f"file://{tmp_path}/w")).select("page_id").collect()
