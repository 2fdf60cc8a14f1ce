import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, score string, held_out string"
SYLLABLES = {"aa": "tion the and er ing ly".split(), "bb": "lich keit und sch ung der".split(), "cc": "ción mente de los ado que".split()}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "aa", "bb", "cc"])
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80))]
        rows.append((i, " ".join(words), lang, "x", "y"))
    return rows


def ended(text):
    """Distinct n-grams that start in the text; those at its end go on in zeros."""
    t = text.lower()
    return {(t + "\0\0\0")[i : i + n] for n in L.ORDERS for i in range(len(t))}


def test_the_whole_method_against_a_plain_twin():
    """Kernel, Nyström map, ridge and prediction as fitted and shipped, by sets and loops; only hash slots may collide."""
    rows = corpus(60)
    texts, langs = [r[1] for r in rows], [r[2] for r in rows]
    model = L.fit(texts, langs, n_landmarks=12)
    names = sorted(set(langs))
    by = {x: [i for i, y in enumerate(langs) if y == x] for x in names}
    order = [i for _, _, i in sorted((k, x, i) for x in names for k, i in enumerate(by[x]))][:12]
    kernel = lambda a, b: len(ended(a) & ended(b)) / np.sqrt(len(ended(a)) * len(ended(b)))
    want = np.array([[kernel(a, texts[j]) for j in order] for a in texts])
    assert np.abs(model.kernel(model.presence(texts)) - want).max() < 5e-3  # slots may collide
    w = np.array([[kernel(texts[i], texts[j]) for j in order] for i in order])
    values, vectors = np.linalg.eigh(w)
    root = vectors @ np.diag([v**-0.5 if v > 1e-6 else 0.0 for v in values]) @ vectors.T
    x = want @ root
    cost = np.diag([len(langs) / len(names) / len(by[y]) for y in langs])
    out = np.zeros((len(texts), len(names)))
    for k, name in enumerate(names):
        y = np.array([1.0 if a == name else -1.0 for a in langs])
        beta = np.linalg.solve(x.T @ cost @ x + 1e-2 * len(langs) / 12 * np.eye(12), x.T @ cost @ y)
        out[:, k] = x @ beta
    share = np.exp(4 * out) / np.exp(4 * out).sum(1, keepdims=True)
    got, score, known = model.predict(texts)
    assert got == [names[i] for i in share.argmax(1)] and np.abs(score - share.max(1)).max() < 0.02
    held = set().union(*(ended(texts[j]) for j in order))
    assert np.abs(known - [len(ended(a) & held) / len(ended(a)) for a in texts]).max() < 0.01


def test_texts_of_no_learned_language_are_told(spark):
    model = L.train(spark.createDataFrame(corpus(400), SCHEMA))
    rng = random.Random(5)
    other = [" ".join("".join(chr(rng.randrange(0x0410, 0x0450)) for _ in range(rng.randint(2, 8))) for _ in range(30)), "zzqx wqzx " * 20, "x"]
    known = model.predict([t for _, t, *_ in corpus(300, 9)] + other)[2]
    assert 0.2 < model.least < known[:300].min() and (known[300:302] < model.least).all()


def test_sample_is_bounded_and_takes_long_texts_where_there_are_no_others(spark):
    rows = [(1, "same text", "aa", "x", "y")] * 50 + [(None, f"text {i} of none", "aa", "x", "y") for i in range(40)] + [(i, "lang " * 5000 + str(i), "bb", "x", "y") for i in range(4)]
    texts, langs = L.sample(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang", F.lit(True), 20, 1000)
    assert len(texts) <= 40 and texts.count("same text") <= 1 and langs.count("bb") == 4 and langs.count("aa") >= 2


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(corpus(400), SCHEMA)
    model = L.train(df)
    got = L.identify(df, model, keep=("doc_id", "lang")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    assert len(got) > 50 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def test_the_text_alone_decides_and_edges(spark):
    model = L.train(spark.createDataFrame(corpus(300), SCHEMA))
    texts = [None, "", " \n", "123 !?", "tionthe ander ing", "TIONTHE ANDER ING", "keit und " * 30000, "\0\0a", "²③", "日本"]
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df, model).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 8)] == [("und", 0.0)] * 5
    assert got[4][0] == "aa" and got[6][0] == "bb" and got[4] == got[5] and got[9][0] in SYLLABLES
    apart = {r.doc_id: (r.lang_pred, r.score) for i in range(10) for r in L.identify(df.where(F.col("doc_id") == i), model).collect()}
    assert all(got[i][0] == apart[i][0] and got[i][1] == pytest.approx(apart[i][1], abs=1e-5) for i in got)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None, "x", "y")], SCHEMA)
    assert L.train(df) is None and [tuple(r) for r in L.identify(df, None).collect()] == [(1, "und", 0.0, 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty, L.train(empty)).collect() == []
