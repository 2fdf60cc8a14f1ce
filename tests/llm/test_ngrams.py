import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import eliasfano as E
from ledgerloom.llm import ngrams as N

SCHEMA = "doc_id long, text string, held_out string, score string, train string"


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 6), (1000, 1000), (1000, 10**9), (3000, 2**45), (300, 70000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n))
    store = E.Store()
    ef = E.EliasFano(store, values, universe)
    store.seal()
    ask = np.unique(np.concatenate((values, rng.integers(0, universe, 500), [0, universe - 1]))).astype(np.int64)
    want = np.searchsorted(values, ask)
    assert (ef.find(ask) == np.where(np.isin(ask, values), want, -1)).all()
    if n:
        assert (ef.successor(ask) == want).all() and (ef.access(np.arange(len(values))) == values).all()


def test_elias_fano_repeats():
    values = np.array([0, 0, 3, 3, 3, 9, 200, 200])
    store = E.Store()
    ef = E.EliasFano(store, values, 201)
    store.seal()
    assert ef.access(np.arange(8)).tolist() == values.tolist()


def test_codes_keep_the_mean():
    values = np.random.default_rng(1).normal(size=5000)
    store = E.Store()
    q = E.Quantised(store, values)
    store.seal()
    got = q[np.arange(5000)]
    assert len(q.book) <= 256 and abs(got.mean() - values.mean()) < 1e-9 and np.abs(got - values).mean() < 0.02


def brute(rows, train):
    """Scores of the plain model by dictionaries, without codes, lists or parts."""
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, (_, t) in enumerate(rows)}
    uni = Counter(w for i in train for w in tokens[i])
    n, v_ = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v_ + 1)

    def grams(i):
        t = ["start", "start", *tokens[i]]
        return [(t[k - 2], t[k - 1], t[k]) for k in range(2, len(t))]

    c3, c2 = defaultdict(Counter), defaultdict(Counter)
    for i in train:
        for u, v, w in grams(i):
            c3[u, v][w] += 1
            c2[v][w] += 1
    out = []
    for i in range(len(rows)):
        total = 0.0
        for u, v, w in grams(i):
            p = p1(w)
            for c, d in ((c2.get(v), N.D2), (c3.get((u, v)) if v != "start" else None, N.D3)):
                if c:
                    s = sum(c.values())
                    p = max(c[w] - d, 0) / s + d * len(c) / s * p
            total += math.log10(p)
        base = sum(math.log10(p1(w)) for w in tokens[i])
        out.append((len(tokens[i]), sum(uni[w] > 0 for w in tokens[i]), n, base, total))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "É"]
    weights = [1 / (i + 1) for i in range(62)]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 8, 60])))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "unseen words only"), (None, "w1 w2 w3"), (3, rows[3][1]), (3, rows[3][1]), (204, "w1 " * 3000), (205, "\x00 a\x0bb")]
    return rows


@pytest.mark.parametrize("exact,bucket,shard,levels", [(1 << 18, 1 << 20, 3_000_000, 10**6), (20, 40, 600, 150), (0, 1 << 20, 2000, 100), (3, 5, 300, 50)])
def test_against_dictionaries(spark, exact, bucket, shard, levels):
    rows = rows_of(exact)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    train = [i for i, (k, _) in enumerate(rows) if k is None or k % 3]
    got = N.score(df, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)), exact=exact, bucket=bucket, shard=shard, levels=levels).collect()
    want = defaultdict(list)
    for (k, _), i, x in zip(rows, range(len(rows)), brute(rows, train)):
        want[k].append((i not in train, *x))
    assert len(got) == len(rows)
    for r in got:
        near = min(want[r.doc_id], key=lambda x: abs(x[4] - r.base_score))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == near[:4]
        assert r.base_score == pytest.approx(near[4], abs=1e-6)
        assert abs(r.score - near[5]) <= 0.02 * r.n_tokens + 0.05


def test_lists_and_splits_change_nothing(spark):
    rows = rows_of(5)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(2)
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    told = lambda **kw: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in N.score(df, train, **kw).collect())
    plain = told()
    for other in ({"exact": 4, "bucket": 30, "shard": 400}, {"exact": 0}, {"bucket": 10, "shard": 200, "levels": 40}):
        got = told(**other)
        assert [x[:4] for x in got] == [x[:4] for x in plain]
        assert max(abs(a[4] - b[4]) / a[1] for a, b in zip(got, plain)) < 0.03


def test_first_words_are_no_hot_pair(spark):
    """Of texts that begin with many words, the parts of the start share the first words; a word stays in one part."""
    known = N.Unigrams(10_000, 500, 5_000, np.sort(N._hashes([b"w0"])), np.array([900]), bucket=100)
    b = N._block(known, 64, [b"w%d rest" % (k % 300) for k in range(3000)])
    first = np.flatnonzero(b.hashes[b.v] == np.uint64(N.START))
    assert len(first) == 3000 and len(np.unique(b.part[first])) > 40 and np.bincount(b.shard[first]).max() < 300
    assert len({(w, p) for w, p in zip(b.w[first].tolist(), b.part[first].tolist())}) == 300


def test_no_training_and_empty(spark):
    none = N.score(spark.createDataFrame([(1, "a b", "x", "y", "z")], SCHEMA), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in none] == [(3, 0, 0, 0.0)]
    assert N.score(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
