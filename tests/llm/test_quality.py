import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality as Q

SCHEMA = "doc_id long, text string, x string, y string, score string"


def slow(model, row):
    total = model.prior
    for feature, at, leaf in zip(model.feature, model.cut, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > at[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_traversal_and_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = Q.fit(x[:1500], y[:1500], trees=30)
    p = model.predict(x)
    assert np.allclose(p[:50], [slow(model, r) for r in x[:50]])
    assert ((p[1500:] > 0.5) == y[1500:]).mean() > 0.97
    assert np.allclose(Q.fit(x[:10], y[:10]).predict(x[:3]), Q.fit(x[:10], y[:10]).predict(x[3:6]))
    assert Q.fit(np.zeros((0, 5)), np.zeros(0)).predict(x[:1])[0] == pytest.approx(0.5)


def test_statistics():
    s = dict(zip(Q.FEATURES, Q.statistics("AB cd ef.\nAB cd ef.\n# 12 é!".encode())))
    assert s["distinct_words"] == 6 / 9 and s["dup_lines"] == pytest.approx(1 / 3) and s["top_word"] == 2 / 9
    assert s["ends_in_stop"] == 1 and s["symbols"] == 1 / 28 and s["words_with_symbol"] == 1 / 9 and s["capitals"] == 2 / 9
    assert Q.statistics(b"") == Q.statistics(b" \n\t") == [0.0] * len(Q.FEATURES)
    assert len(Q.statistics(b"a")) == len(Q.statistics(b"a b")) == len(Q.FEATURES)


def test_held_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [rng.choice("tion the and er ing ly".split()) + str(rng.randint(0, 50)) * good for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "x", "y", "z"))
        labels.append((i, int(good)))
    rows += [(1000, None, "x", "y", "z"), (1001, "", "x", "y", "z"), (None, "a b", "x", "y", "z"), (1002, "w " * 50000, "x", "y", "z"), (5, rows[5][1], "x", "y", "z")]
    labels += [(3, None), (None, 1), (7, 1), (7, 0), (9999, 1)]
    stats = Q.features(spark.createDataFrame(rows, SCHEMA))
    model = Q.train(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = Q.score(stats, model).withColumn("held", F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2).collect()
    truth = dict(labels[:600])
    held = [(r.score, truth[r.id]) for r in got if r.held and r.id in truth]
    assert len(got) == 605 and len(held) > 80 and np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels_and_empty(spark):
    stats = Q.features(spark.createDataFrame([(1, "a b", "x", "y", "z")], SCHEMA))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score(stats, Q.train(stats, none)).collect()] == [pytest.approx(0.5)]
    assert Q.score(Q.features(spark.createDataFrame([], SCHEMA)), Q.train(stats, none)).collect() == []
