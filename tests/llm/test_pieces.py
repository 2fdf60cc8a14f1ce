import random

import numpy as np
import pytest

from ledgerloom.llm import pieces as P

SCHEMA = "doc_id long, text string, token_ids string, n_tokens string"


def small():
    texts = ["▁", "▁a", "▁ab", "a", "b", "ab", "abc", "c", "bc", "é", "▁é", "cab", "▁▁", "x"]
    rng = random.Random(4)
    pieces = ["<unk>", "<s>"] + [f"<0x{i:02X}>" for i in range(256)] + texts
    scores = [0.0] * 258 + [-float(rng.randint(1, 9)) for _ in texts]
    return P.Vocabulary.of(pieces, scores, ["other"] * 2 + ["byte"] * 256 + ["normal"] * len(texts)), dict(zip(texts, scores[258:])), pieces


def best_score(text, scores):
    low = min(scores.values()) - 10
    best = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        if text[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + low)
        for j in range(i + 1, min(i + 4, len(text)) + 1):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
    return best[-1]


def score_of(ids, pieces, scores):
    """Score of ids; a character's bytes count once."""
    low, total, pending = min(scores.values()) - 10, 0.0, b""
    for i in ids:
        if pieces[i].startswith("<0x"):
            pending += bytes([int(pieces[i][3:5], 16)])
            try:
                pending.decode()
                total, pending = total + low, b""
            except UnicodeDecodeError:
                pass
        else:
            total += scores[pieces[i]]
    assert not pending
    return total


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_is_optimal_and_decodes(seed):
    vocabulary, scores, pieces = small()
    rng = random.Random(seed)
    texts = ["".join(rng.choices("aabbcc xé中\n😀 ", k=rng.randint(0, 40))) for _ in range(200)] + ["abc" * 3000]
    for t, ids in zip(texts, vocabulary.encode_all(texts, P.Cache())):
        ids = ids.tolist()
        assert vocabulary.decode(ids) == t
        if t:
            assert score_of(ids, pieces, scores) == pytest.approx(best_score("▁" + t.replace(" ", "▁"), scores))


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", bytes([255, 1]), b"bca"]
    base, check, value = P.double_array(keys)

    def look(key):
        s = 0
        for b in key:
            t = base[s] + b
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert [look(k) for k in keys] == list(range(6)) and [look(k) for k in (b"c", b"bc", b"abcd", b"")] == [-1] * 4


def as_unigram(raw):
    """The model file with trainer_spec.model_type (field 2, then 3) set from 2, BPE, to 1, unigram."""

    def varint(i):
        n = shift = 0
        while True:
            n |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return n, i

    def fields(i, end):
        while i < end:
            tag, i = varint(i)
            at, size = i, {1: 8, 5: 4}.get(tag & 7)
            if tag & 7 == 2:
                size, i = varint(i)
                at = i
            elif tag & 7 == 0:
                size = varint(i)[1] - i
            yield tag >> 3, at, size
            i = at + size

    for top, at, size in fields(0, len(raw)):
        for field, place, _ in fields(at, at + size) if top == 2 else ():
            if field == 3:
                assert raw[place] == 2
                return raw[:place] + b"\x01" + raw[place + 1 :]


def test_no_path_of_the_library_scores_higher_on_the_same_pieces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(P.MODEL_PATH, "rb").read()))
    vocabulary = P.Vocabulary.load(ranks=False)
    total = lambda ids: sum(map(sp.get_score, ids))
    same = 0
    texts = ["the sting of entions", "Hello world and others", "einlich der schen", "abc", "tion the the.", "Anblewh sttible athawh thonre was"]
    for t in texts:
        ours, theirs = vocabulary.encode(t), sp.encode(t)
        assert total(ours) >= total(theirs) and sp.decode(ours) == t
        same += ours == theirs
    assert same


def test_paths_are_the_librarys_under_log_scores():
    import sentencepiece

    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    vocabulary = P.Vocabulary.load()
    assert abs(np.exp(vocabulary.scores).sum() - 1) < 1e-9 and (np.diff(vocabulary.scores) < 0).all()
    proto = pb2.ModelProto.FromString(open(P.MODEL_PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, score in zip(vocabulary.ids.tolist(), vocabulary.scores.tolist()):
        proto.pieces[i].score = score
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    total = lambda ids: sum(map(sp.get_score, ids))
    texts = ["the sting of entions", "Hello world and others", "einlich der schen", "abc", "tion the the.", "Anblewh sttible athawh thonre was", "international understanding"]
    for t in texts:
        ours, theirs = vocabulary.encode(t), sp.encode(t)
        assert total(ours) == pytest.approx(total(theirs), rel=1e-5) and sp.decode(ours) == t
    plain = P.Vocabulary.load(ranks=False)
    assert sum(len(vocabulary.encode(t)) for t in texts) < sum(len(plain.encode(t)) for t in texts)


def test_rows(spark):
    texts = [None, "", " ", "  a  b\n", "▁x", "word " * 5000, "\x00퟿", "é" * 3000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    vocabulary = P.Vocabulary.load()
    tokens = P.encode(df, vocabulary)
    rows = {r.doc_id: r for r in tokens.collect()}
    assert [rows[i].round_trip for i in range(8)] == [None, True, True, True, False, True, True, True]
    assert rows[0].token_ids is None and rows[1].token_ids == [] and rows[0].n_tokens == 0
    assert all(r.n_tokens == len(r.token_ids or []) and r.n_fallback == sum(3 <= x < 259 for x in r.token_ids or []) for r in rows.values())
    back = {r.doc_id: r.text for r in P.decode(tokens, vocabulary).collect()}
    assert [back[i] for i in (0, 1, 2, 3, 5, 6, 7)] == [texts[i] for i in (0, 1, 2, 3, 5, 6, 7)]
    assert P.encode(spark.createDataFrame([], SCHEMA), vocabulary).collect() == []
