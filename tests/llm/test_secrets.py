import hashlib
import random
import re

import pytest

from ledgerloom.llm import secrets as S

SCHEMA = "doc_id long, text string, spans string, n_hex string"


def plain(text):
    t, out = text or "", []
    patterns = [
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m.group(2)) >= 8),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m.group()) >= 16),
        (r"[0-9a-f]+", 0, lambda m: len(m.group()) >= 32),
    ]
    for k, (p, flags, ok) in enumerate(patterns):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t, flags) if ok(m)]
    return ",".join(f"{S.BASE_KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


CASES = [
    None, "", "no secret here", "password=abcdefgh1", "PassWord : 'abcdefgh.=1'", "secret: token = abcdefgh123", "token=short",
    "é\U0001f600 api_key=\"ABCDEFGH\" apikey:12345678", "AKIA" + "A" * 11, "AKIA" + "B2" * 6, "AKIAKIAAKIA" + "9" * 12,
    "0" * 31, "ab" * 16, "x" + "f" * 40 + "g", "token = \"" + "1a" * 20 + "\"", "passſwd=abcdefghij ſecret=abcdefghij",
    "toKen=abcdefghij", "password==" + "z" * 9, "long " * 40000 + "secret=" + "q" * 5000,
]


def test_base_spans_and_counts(spark):
    rows = S.find_secrets(spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(CASES)], SCHEMA)).collect()
    for r in rows:
        want = plain(CASES[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (CASES[r.doc_id], r.spans, want)
        assert {x for x in want.split(",") if x} <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in S.BASE_KINDS)


def test_held_out_credentials_are_found_and_words_are_not():
    found, rng = S.model(), random.Random(5)
    for kind, strings in S.labelled(seed=99, each=60).items():
        hits = S.scan([f"some words {s} and more" for s in strings], found, 2.0)
        assert sum(any(k == kind for k, _, _ in all_) for _, all_ in hits) >= 57, kind
    syllables = ["tion", "the", "er", "lich", "keit", "ment", "eau", "ción", "Sch", "AK", "gh", "sk_", "-", "/"]
    words = [" ".join("".join(rng.choices(syllables, k=rng.randint(4, 14))) for _ in range(50)) for _ in range(200)]
    assert not any(all_ for _, all_ in S.scan(words, found, 2.0))


def test_automaton_is_a_distribution_and_generalises():
    go, cost, end, length = S.Automaton(["ab" * k for k in range(1, 8) for _ in range(2 ** (9 - k))]).tables()
    import numpy as np

    mass = np.exp(cost).sum(1)[:-1] + np.exp(end)[:-1]
    assert np.allclose(mass, 1) and len(mass) < 6


@pytest.mark.parametrize("spans,want", [([], "0123456789"), ([("x", 2, 4)], "01#456789"), ([("x", 2, 6), ("y", 4, 8)], "01#89"), ([("x", 0, 9), ("y", 2, 3)], "#9")])
def test_redact(spans, want):
    assert S.redact("0123456789", spans, "#") == want


def test_empty_table(spark):
    assert S.find_secrets(spark.createDataFrame([], SCHEMA), redacted=True).collect() == []


def test_other_lengths_and_glue():
    rng = random.Random(3)
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    url = S.ALNUM + "-_"
    hub = "ghp_" + draw(S.ALNUM, 36)
    cases = [(f"see {a}{hub}{b} now", "github", hub) for a, b in [("", ""), ("https://example.com/", ""), ("user-", ""), ("", ".Next"), ("a/b_", "-c")]]
    for n in (25, 75, 150, 400):
        for tail in (43, 86, 342):
            jwt = f"eyJ{draw(url, 20)}.eyJ{draw(url, n)}.{draw(url, tail)}"
            cases.append((f"Bearer {jwt} end", "jwt", jwt))
    for n in (10, 12, 13):
        slack = f"xoxb-{draw(S.DIGIT, n)}-{draw(S.DIGIT, n)}-{draw(S.ALNUM, 24)}"
        cases.append((f"use {slack} here", "slack", slack))
    hits = S.scan([t for t, _, _ in cases], S.model(), 2.0)
    for (text, kind, secret), (_, spans) in zip(cases, hits):
        at = text.index(secret)
        assert (kind, at, at + len(secret)) in spans, (text, spans)
