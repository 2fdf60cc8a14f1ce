"""Text expressions whose white space is that of Unicode, as the data contract has it."""

from __future__ import annotations

import functools
import itertools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the contract for Java's engine: Unicode spaces, U+001C to U+001F and U+0085.
SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """What full case folding makes of single characters: two strings of equal length, and those that become several."""
    changed = {c: c.casefold() for c in map(chr, itertools.chain(range(0xD800), range(0xE000, sys.maxunicode + 1))) if c.casefold() != c}
    one = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in changed.items() if len(f) > 1}


def casefold_sql(text: str) -> str:
    """SQL of the full case folding of an expression, for which Spark has no function (lower() keeps the sharp s)."""
    old, new, several = _folds()
    pairs = ", ".join(f"'{c}', '{f}'" for c, f in several.items())
    spread = f"array_join(transform(split({text}, ''), _c -> coalesce(try_element_at(map({pairs}), _c), _c)), '')"
    return f"translate(CASE WHEN {text} RLIKE '[{''.join(several)}]' THEN {spread} ELSE {text} END, '{old}', '{new}')"


def casefold(text: Column | str) -> Column:
    """Full case folding, as casefold_sql() has it."""
    column = F.col(text) if isinstance(text, str) else text
    return F.get(F.call_function("transform", F.array(column), F.expr(f"_t -> {casefold_sql('_t')}")), F.lit(0))


def collapse_sql(text: str) -> str:
    """SQL of collapse()."""
    return f"trim(regexp_replace({text}, r'{SPACES}+', ' '))"


def json_quoted(text: Column) -> Column:
    """A JSON string literal with characters beyond ASCII as they are."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"}), '(?s)^\\{"v":(.*)\\}$', 1)


def html_escaped(text: Column) -> Column:
    """Text for an HTML body or attribute: & < > and both quotes as references."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def duration(seconds: Column) -> Column:
    """h:mm:ss of non-negative seconds, null of others."""
    whole = F.floor(seconds).cast("long")
    told = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)))
    return F.when(finite(seconds) & (seconds >= 0), told)


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    """Part of total in percent as text, null without a total."""
    return F.when(total > 0, F.concat(F.format_number(100 * part / total, digits), F.lit("%")))


def plain_console(text: Column) -> Column:
    """Text without terminal escape sequences and control characters."""
    text = F.regexp_replace(text, "\\x{1b}\\][^\\x{07}\\x{1b}]*(\\x{07}|\\x{1b}\\\\)", "")
    text = F.regexp_replace(text, "\\x{1b}\\[[0-?]*[ -/]*[@-~]", "")
    return F.regexp_replace(text, "[\\p{Cc}\\p{Cf}&&[^\\t]]", "")


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def merged(first: Column, second: Column) -> Column:
    """A map of both maps' keys; where both have one, the second's value."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)


def tail_bytes(text: Column, n: int = 8192) -> Column:
    """The last n bytes of a text, as text; a character cut at the front becomes its replacement."""
    raw = text.cast("binary")
    return F.make_valid_utf8(F.substring(raw, F.greatest(F.octet_length(raw) - n, F.lit(0)) + 1, F.lit(n)).cast("string"))
