"""Quality rules as a bitmask ledger: DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule names; a rule's bit is its place here.
RULES = ("few_words", "repeat_words", "word_length", "symbols", "dup_lines", "bullets", "ellipses")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(x) for x in self.rules)


BASE = Policy("base", ("few_words", "repeat_words"))
POLICIES = (
    BASE,
    Policy("v1", BASE.rules + ("symbols", "dup_lines")),
    Policy("v2", BASE.rules + ("symbols", "dup_lines", "word_length", "bullets", "ellipses")),
)

_SPLIT = "[\\x20\\x09-\\x0D]+"


def _present(array: Column) -> Column:
    return F.array_remove(array, "")


def _covered(positions: Column) -> Column:
    """Words that windows of three at these ascending positions cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(positions, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of each whole text, one row per row of docs; a null text counts as empty.

    n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_lines (with a word),
    n_dup_lines (equal to an earlier line), n_bullets, n_ellipses (lines that begin with a bullet,
    end with an ellipsis), n_repeat_words (words in three-word windows found twice or more).
    Windows are equal if their three words are; hashes only tell which texts have repeated ones. All is
    done inside the row: no shuffle, no array beyond one text's words, and rows that repeat, or share or lack
    an id, are measured like others. Other columns of docs are ignored, whatever their names.
    """
    df = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.select(id_col, "t", _present(F.split("t", _SPLIT)).alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    df = df.select(
        id_col,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", _SPLIT, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ellipses"),
        F.when(
            F.size("words") >= 4,
            F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).alias("hashes"),
    )
    known = [c for c in df.columns if c not in ("words", "hashes")]
    # Only texts with a repeated window sort their windows.
    window = lambda h, i: F.struct(*[F.get("words", i + k).alias(f"w{k}") for k in range(3)], i.alias("i"))
    df = df.select(*known, F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.sort_array(F.transform("hashes", window))).alias("runs"))
    same = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    twice = F.filter("runs", lambda x, i: F.coalesce(same(F.get("runs", i - 1), x), F.lit(False)) | F.coalesce(same(F.get("runs", i + 1), x), F.lit(False)))
    df = df.select(*known, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    return df.select(*known, F.when(F.col("at").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("at"))).alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """When each rule fails, over the columns of measure(); exact integer comparisons."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeat_words": 100 * F.col("n_repeat_words") > 50 * n,
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "bullets": 10 * F.col("n_bullets") > 9 * F.col("n_lines"),
        "ellipses": 10 * F.col("n_ellipses") > 3 * F.col("n_lines"),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() and fail_bits: bit i is set if rule RULES[i] fails. Every rule runs once."""
    bits = F.lit(0).cast("long")
    for i, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failures()[name], F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def verdict(policy: Policy, bits: str = "fail_bits") -> Column:
    """True if no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledgered: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it fails, rows only it fails, rows kept without it.

    The ledger shrinks to one count per failure mask (at most 2^rules rows) before anything else.
    """
    masks = ledgered.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << RULES.index(x)).cast("long").alias("bit")) for x in policy.rules])
    each = masks.select("m", "n", F.explode(rules).alias("r"))
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        n_if(F.col("m").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        n_if(F.col("m") == F.col("r.bit")).alias("n_failed_alone"),
        n_if(F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
        F.bit_or("m").alias("masks_seen"),
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the last policy: documents it fails, fails alone, and kept without it, from the ledger's masks."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES[-1])


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of all whole documents."""
    found = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(BASE)).alias("base_failed"), verdict(POLICIES[-1]).alias("kept"),
        "fail_bits", verdict(POLICIES[1]).alias("kept_v1"), "n_lines", "n_bullets", "n_ellipses",
    )


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT rid, doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
u AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s),
k AS (SELECT rid, i, w, lead(w) OVER a AS w2, lead(w, 2) OVER a AS w3 FROM u WINDOW a AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM k WHERE w3 IS NOT NULL),
p AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM c WHERE n >= 2) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipses
  FROM s LEFT JOIN p USING (rid)),
f AS (
  SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
     + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 4 ELSE 0 END
     + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END
     + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END
     + CASE WHEN 10 * n_bullets > 9 * n_lines THEN 32 ELSE 0 END
     + CASE WHEN 10 * n_ellipses > 3 * n_lines THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept, fail_bits,
  (fail_bits & 27) = 0 AS kept_v1, n_lines, n_bullets, n_ellipses
FROM f
"""

ABLATIONS_SQL = f"""
WITH o AS (SELECT fail_bits & {POLICIES[-1].mask} AS m FROM ({OP6_SQL})), r AS (SELECT * FROM (VALUES {", ".join(f"('{x}', {1 << RULES.index(x)})" for x in POLICIES[-1].rules)}) v(rule, bit))
SELECT rule, count(*) FILTER (WHERE m & bit <> 0) AS n_failed, count(*) FILTER (WHERE m = bit) AS n_failed_alone, count(*) FILTER (WHERE m & ~bit = 0) AS n_kept_without, bit_or(m) AS masks_seen FROM o, r GROUP BY rule
"""
