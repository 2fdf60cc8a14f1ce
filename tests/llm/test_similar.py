import random

import corpus_pipeline as C

from ledgerloom.llm import similar as S


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, least=0.8):
    """Smallest id reachable by pairs of that Jaccard similarity; all pairs are compared."""
    rows, sets = sorted(rows, key=lambda r: r[0]), {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}
    for i, _ in rows:
        for j, _ in rows:
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def edited():
    """Texts and copies of them with some words replaced, so that similarities lie around 0.8."""
    rng, out = random.Random(4), []
    for i in range(60):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(4, 250))]
        out.append((10 * i, " ".join(words)))
        for k in range(4):
            copy = words[:]
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                copy[rng.randrange(len(copy))] = "x" + str(rng.random())
            out.append((10 * i + 5 + k - 7 * (k == 2), " ".join(copy).upper() if k == 1 else " ".join(copy)))
    return out + [(9000, ""), (9001, None), (9002, "one"), (9003, "One")]


def test_like_all_pairs(spark):
    rows = edited()
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 60 < len(set(want.values())) < len(rows) - 60


def test_groups_dealt_into_tiles(spark):
    rng, words = random.Random(9), [f"w{i}" for i in range(150)]
    rows = [(7, " ".join(words))]
    for i in range(90):
        copy = words[:]
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((100 + i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(rows, "doc_id long, text string"), tile=7).collect()}
    want = brute(rows)
    assert got == want and 5 < len(set(want.values())) < 80


def test_the_stage_drops_near_copies_that_fingerprints_miss(spark):
    rows = list({i: (i, t) for i, t in edited() if t}.values())
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in [*rows, rows[3], (None, "no id at all")]], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(C.STAGES)["near_duplicates"]
    kept = sorted(r.doc_id for r in stage(spark, docs, "").collect())
    want = {i for i, r in brute(rows).items() if i == r}
    by_prints = {r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect()}
    assert set(kept) <= want & by_prints and len(kept) == len(set(kept)) and len(by_prints) > len(kept) + 20


def test_roots_of_a_chain():
    import numpy as np

    sets = [np.arange(k, k + 30, dtype=np.uint64) for k in (0, 6, 3, 100)]
    assert S.exact_roots(sets, 0.8).tolist() == [0, 0, 0, 3]
