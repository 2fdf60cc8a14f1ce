import random

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, secrets
from ledgerloom.llm.pieces import Vocabulary
from tests.llm.test_simhash import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def rows():
    rng = random.Random(8)
    syllables = {"en": "tion the and er ing ly".split(), "de": "lich keit und sch ung der".split()}
    out = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120)))
        if i % 10 == 0:
            text += " password=0123456789abcdef"
        out.append((i, text, lang if i % 7 else None, rng.choice(["a", "b", None])))
    out += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "12 34", "en", "b"), (203, out[4][1], "en", "b"), (204, out[5][1] + " extra", "de", "a"), (5, out[5][1], "de", "a"), (None, "und lich keit der", "de", "b")]
    return [(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in out]


def test_stages_one_by_one(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    identified = C.keep_identified(spark, docs, "").cache()
    got = identified.collect()
    assert identified.columns == list(C.COLUMNS) and len(got) == len(rows()) - 3
    assert all(r.lang in ("en", "de") for r in got) and not {200, 201, 202} & {r.doc_id for r in got}

    unique = C.drop_near_duplicates(spark, identified, "").cache()
    keep = {k for k, _, root in brute([(r.doc_id, r.text) for r in got]) if k is not None and k == root}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(keep) and 203 not in keep

    clean = C.redact_secrets(spark, unique, "").cache()
    before = {r.doc_id: r for r in unique.collect()}
    for r in clean.collect():
        spans = secrets.scan([before[r.doc_id].text], secrets.model(), 2.0)[0][1]
        assert r.text == secrets.redact(before[r.doc_id].text, spans) and r.n_chars == len(r.text) and "0123456789abcdef" not in r.text
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)

    mixed = C.mix_sources(spark, clean, "").cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    seen = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert seen == {k: n for k, n in copies.items() if n} and mixed.columns == list(C.COLUMNS)

    last = C.encode_pieces(spark, mixed, "").collect()
    vocabulary, text = Vocabulary.load(), {r.doc_id: r.text for r in clean.collect()}
    assert len(last) == mixed.count() and all(vocabulary.decode(r.token_ids) == text[r.doc_id] for r in last)


def test_a_text_of_no_learned_language_goes(spark):
    rng = random.Random(3)
    odd = " ".join("".join(chr(rng.randrange(0x0410, 0x0450)) for _ in range(6)) for _ in range(40))
    docs = spark.createDataFrame([*rows(), (900, odd, None, "a", len(odd), "x"), (900, odd, None, "a", len(odd), "x")], SCHEMA)
    kept = [r.doc_id for r in C.keep_identified(spark, docs, "").collect()]
    assert 900 not in kept and len(kept) == len(rows()) - 3


@pytest.mark.parametrize("many", [True, False])
def test_run(spark, tmp_path, many):
    at = tmp_path / "sf"
    spark.createDataFrame(rows() if many else [], SCHEMA).drop("extra").write.parquet(f"{at}/documents.parquet")
    out = C.run(spark, str(at))
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "n_fallback", "round_trip"]
    assert (out.where(F.col("round_trip")).count() > 100) == many
