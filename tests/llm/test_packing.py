import bisect
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing

LONG = "keit und der password=abcdefgh12 " * 6_000
ROWS = [
    (1, "the same text of a few words", "a"), (1, "the same text of a few words", "a"), (None, "no id", None), (None, "no id", None), (2, None, "a"), (3, "", "b"), (4, " \n\t\x0b\x0c", "b"),
    (5, LONG, "b"), (6, "x" * 30_000, "b"), (7, "İstanbul ΑΣ Σ 's it's <|endoftext|>x ́y é \x1c! ?", "c"), (8, "hello " * 4095, "c"), (9, "hello " * 4096, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("clash").alias(n) for n in ("piece", "length", "ids", "offset", "_key", "n")]).repartition(3).cache()


def best_fit(counts):
    """Sequences that plain best-fit decreasing needs."""
    rooms, n = [], 0
    for length in range(len(counts) - 1, 0, -1):
        for _ in range(int(counts[length])):
            at = bisect.bisect_left(rooms, length)
            n += at == len(rooms)
            free = (rooms.pop(at) if at < len(rooms) else len(counts) - 1) - length
            if free:
                bisect.insort(rooms, free)
    return n


def test_ids_are_those_of_the_whole_texts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for doc, text, _ in ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        expected += [(doc, k, a, ids[a : a + 4096]) for k, a in enumerate(range(0, len(ids), 4096))]
    got = packing.tokenise(docs).collect()
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    assert {(r.doc_id, r.length) for r in got if r.doc_id in (2, 3, 4)} == {(2, 1), (3, 1), (4, 1)}
    assert [r.length for r in got if r.doc_id == 8] == [4096] and sorted(r.length for r in got if r.doc_id == 9) == [1, 4096]


def test_words_together_are_words_one_by_one():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words = ['("Haus,', "Über.", "don't", "it's.", "x1", "naïve", "(a)", "...", "[ÀÖØ]-", "ſtraße!", "a\u0301b", "日本", "ab\u00a0c", "<|endoftext|>", "AKIA-x", "ɏ?", "İx", "ǅ", "e-f"] * 3
    whole = Tokenizer.from_file(path)
    starts, sizes, ids = packing.Encoder(path).segment(words)
    assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes)] == [whole.encode(w, add_special_tokens=False).ids for w in words]


def test_cache_may_be_dropped_between_blocks():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    one, many = packing.Encoder(path, cached=3), packing.Encoder(path)
    for texts in ([b"a b c d", b""], [b"d c b a " * 3], [b"x. y, z"], [b"a x. nota bene x."], [b"", b"bene nota a"]):
        assert [x.tolist() for x in one(texts)] == [x.tolist() for x in many(texts)]


def test_windows_of_a_long_text_part_at_spaces():
    text = b"ab cde  f\nghij" * 9
    assert [w for c in packing._chunks(text, 5) for w in c] == text.split() and list(packing._chunks(b"")) == [[]]


def test_places_have_no_gaps_and_no_overlaps(docs):
    got = packing.place(packing.tokenise(docs)).collect()
    assert len(got) == packing.tokenise(docs).count()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_sequences_hold_the_ids_of_their_pieces(docs):
    placed = packing.place(packing.tokenise(docs)).cache()
    rows = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        whole = rows[r.sequence_id]
        assert bytes(whole.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and r.offset + r.length in whole.ends


def test_no_rows(docs):
    assert packing.place(packing.tokenise(docs.where("false"))).collect() == []


def test_lengths_out_of_range_are_refused(spark):
    for bad in (0, 4097, None):
        with pytest.raises(Exception, match="length out of range"):
            packing.place(spark.createDataFrame([(1, bad)], "doc_id long, length long")).collect()


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_BUCKET", 50)
    rows = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1500).otherwise(F.col("id") % 4096 + 1).cast("long").alias("length"))
    got = packing.place(rows).toPandas()
    assert len(got) == 3000 and not got.duplicated(["sequence_id", "offset"]).any()
    totals = got.groupby("sequence_id").agg(n=("length", "sum"))
    assert totals.n.max() <= 4096
    ends = got.assign(end=got.offset + got.length).sort_values(["sequence_id", "offset"])
    assert (ends.offset == ends.groupby("sequence_id").end.shift(fill_value=0)).all()


CASES = {
    "mixed": lambda r: np.minimum(4096, r.lognormal(6.5, 1.2, 20000).astype(int) + 1), "long": lambda r: r.integers(900, 3000, 9000), "halves": lambda r: np.r_[np.full(999, 2049), np.full(500, 2047)],
    "thirds": lambda r: r.integers(1200, 1600, 9000), "even": lambda r: r.integers(1, 4097, 9000), "copies": lambda r: np.r_[np.full(9000, 1500), r.integers(1, 4097, 9000)],
    "none": lambda r: np.zeros(0, int), "one": lambda r: np.array([4096]), "tiny": lambda r: np.ones(9000, int),
}


@pytest.mark.parametrize("case", CASES)
def test_plan_holds_every_piece_and_comes_near_best_fit(case):
    counts = np.bincount(CASES[case](np.random.default_rng(5)), minlength=4097)
    found = packing.plan(counts)
    held = np.zeros(4097, int)
    for n, parts in found.runs:
        assert sum(length * m for length, m in parts) <= 4096
        for length, m in parts:
            held[length] += n * m
    assert (held == counts).all() and found.sequences <= best_fit(counts) * 1.005 + 1
    assert len(found.runs) < 9000


def test_nnls_agrees_with_a_slow_descent():
    r = np.random.default_rng(3)
    a, b = r.random((12, 20)), r.random(12)
    x = np.zeros(20)
    step = 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(200_000):
        x = np.maximum(0, x - step * (a.T @ (a @ x - b)))
    got = packing.nnls(a, b)
    assert (got >= 0).all() and np.linalg.norm(a @ got - b) <= np.linalg.norm(a @ x - b) + 1e-6


def test_patterns_are_all_multisets_that_fill_a_sequence():
    brute = {tuple(sorted(p, reverse=True)) for p in [(a, b, 12 - a - b) for a in range(13) for b in range(13 - a)]}
    assert {tuple(c for c in p if c) for p in brute} == set(packing.patterns(12, 3))


def test_checksums(docs):
    got = packing.tokenise(docs).withColumn("c", F.crc32("ids")).collect()
    assert all(zlib.crc32(r.ids) == r.c for r in got)
