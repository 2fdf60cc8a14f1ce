"""Answers as data: response status, timing, numeric error, token sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import Rule


def response_status(*, late: Column, stopped: Column, prompt_agrees: Column, count_agrees: Column, forced: Column, at_limit: Column, at_end: Column) -> Column:
    """Status of a captured response; the first reason that holds decides."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(late, "TIMEOUT").when(no(stopped), "CAPTURE_INCOMPLETE").when(no(prompt_agrees), "PROMPT_OR_CACHE_MISMATCH").when(no(count_agrees), "TOKEN_COUNT_MISMATCH")
        .when(forced & at_limit, "PROBE_COMPLETE").when(forced, "PROBE_INCOMPLETE").when(at_end, "COMPLETE").otherwise("TERMINATION_MISMATCH")
    )


def assessed(tokens: Column, terminal: Column, *, prompt_length: Column, eos: Column, maximum: Column, forced: Column, late: Column) -> Column:
    """response_status() of a token array and a terminal record."""
    n = F.size(tokens)
    t = lambda name: terminal[name]
    prompt = (~t("truncated")) & (t("tokens_evaluated") == prompt_length) & (t("timings")["cache_n"] == 0) & (t("timings")["prompt_n"] == prompt_length)
    return response_status(
        late=late, stopped=t("stop"), prompt_agrees=prompt, count_agrees=(t("tokens_predicted") == n) & (n <= maximum), forced=forced,
        at_limit=(n == maximum) & (t("stop_type") == "limit"), at_end=(t("stop_type") == "eos") & (F.get(tokens, n - 1) == eos),
    )


def timing_summary(chunks: DataFrame, key: str, at: str, tie: list[str], edge: int = 64) -> DataFrame:
    """For each key: chunks, first and last arrival, and the spans of the first and the last 64 chunks.

    The 64th from either end is found under a row limit that Spark also applies before the shuffle, so a
    key with very many chunks is cut down where it is read.
    """
    total = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))

    def nth(name: str, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return chunks.withColumn("_n", place).where(F.col("_n") <= edge).where(F.col("_n") == edge).select(key, F.col(at).alias(name))

    columns = [F.col(c) for c in (at, *tie)]
    both = total.join(nth("_early", *columns), key, "left").join(nth("_late", *[c.desc() for c in columns]), key, "left")
    return both.select(key, "chunks", "first_us", "last_us", (F.col("_early") - F.col("first_us")).alias("first_64_us"), (F.col("last_us") - F.col("_late")).alias("last_64_us"))


def vector_error(a: Column, b: Column) -> dict[str, Column]:
    """Largest absolute and relative Euclidean difference of two arrays, relative to the second (1e-30 at least)."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return {"max_abs": F.array_max(F.transform(d, F.abs)), "relative": F.sqrt(square(d)) / F.greatest(F.sqrt(square(b)), F.lit(1e-30))}


def sequence(prompt: Column, answer: Column, limit: Column) -> dict[str, Column]:
    """input_ids, labels (-100 over the prompt) and attention_mask; null where the limit is exceeded, never cut."""
    ids = F.concat(prompt, answer)
    fits = (F.size(ids) <= limit) & (F.size(answer) > 0)
    of = lambda c: F.when(fits, c)
    return {"input_ids": of(ids), "labels": of(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), answer)), "attention_mask": of(F.array_repeat(F.lit(1), F.size(ids)))}


def padded(ids: Column, length: Column, value: int) -> Column:
    """An array filled up to a length."""
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def after_single_end(ids: Column, eos: int) -> Column:
    """Ids up to their only end token; null if there is none, or more than one."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(F.size(F.filter(ids, lambda x: x == eos)) == 1, F.slice(ids, 1, at))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    """Messages in their three roles."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(said("system", system), said("user", user), said("assistant", assistant))


def roles_hold(said: Column) -> Column:
    """True for just the roles system, user, assistant, none of them empty."""
    roles = F.transform(said, lambda m: m["role"])
    return (roles == F.array(*map(F.lit, ("system", "user", "assistant")))) & F.forall(said, lambda m: F.length(m["content"]) > 0)


def input_rules(text: Column, reserved: tuple[str, ...], begin: str, end: str, limit: int = 1 << 20) -> list[Rule]:
    """What a model's input may not be: too large, holding reserved marks, or without just one target in its marks."""
    count = lambda mark: F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark))
    return [
        Rule("size", F.octet_length(text) > limit, "the input is too large"),
        Rule("reserved", reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in reserved]), "a reserved mark in the input"),
        Rule("begin", count(begin) != 1, "not just one begin mark"),
        Rule("end", count(end) != 1, "not just one end mark"),
        Rule("order", (F.instr(text, begin) > F.instr(text, end)) & (F.instr(text, end) > 0), "the target ends before it begins"),
    ]


def limit_rules(prompt: Column, answer: Column, *, context: int, prompts: int, answers: int) -> list[Rule]:
    """Limits of token arrays, which are never cut."""
    return [
        Rule("prompt", F.size(prompt) > prompts, "the prompt is too long"),
        Rule("answer", F.size(answer) > answers, "the answer is too long"),
        Rule("context", F.size(prompt) + F.size(answer) > context, "prompt and answer are too long together"),
        Rule("empty", F.size(answer) < 1, "no answer"),
    ]


def trained(prompt: Column, answer: Column, eos: int, limit: int) -> dict[str, Column]:
    """sequence() of an answer cut after its single end token, with the lengths; null where there is no such token."""
    cut = after_single_end(answer, eos)
    parts = sequence(prompt, cut, F.lit(limit))
    return parts | {"prompt_length": F.when(parts["input_ids"].isNotNull(), F.size(prompt)), "answer_length": F.when(parts["input_ids"].isNotNull(), F.size(cut))}


def request_body(said: Column, maximum: int) -> Column:
    """The JSON of a generation request: greedy, streamed, no reuse of earlier prompts."""
    return F.to_json(F.struct(said.alias("messages"), F.lit(maximum).alias("max_tokens"), F.lit(0).alias("temperature"), F.lit(True).alias("stream"), F.lit(False).alias("cache_prompt")))


def failures(status: Column) -> Column:
    """How many answers of a group did not end by themselves or at their limit."""
    return F.count_if(~F.coalesce(status.isin("COMPLETE", "LENGTH_STOP"), F.lit(False)))
