"""Strict JSON, four canonical encodings of it, and hashes over them."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The encodings that identities are bound to.
FORMS = {
    "target": {"sort_keys": True, "separators": (",", ":"), "ensure_ascii": False},
    "binding": {"sort_keys": True, "ensure_ascii": False, "allow_nan": False},
    "row": {"ensure_ascii": False, "allow_nan": False},
    "draft": {"sort_keys": True, "separators": (",", ":")},
}


class NotStrict(ValueError):
    """The text is no JSON in the strict sense."""


def _object(pairs: list[tuple[str, Any]]) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        names = [k for k, _ in pairs]
        raise NotStrict(f"key stands twice: {next(k for k in names if names.count(k) > 1)}")
    return made


def _constant(name: str):
    raise NotStrict(f"no JSON number: {name}")


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_constant)


def strict_loads(text: str | bytes) -> Any:
    """Parses JSON; repeated keys, NaN and infinities, and anything after the value are errors."""
    try:
        return _DECODER.decode(text.decode() if isinstance(text, bytes) else text)
    except NotStrict:
        raise
    except (ValueError, RecursionError) as e:
        raise NotStrict(str(e)) from None


def strict_variant(text: Column) -> Column:
    """The variant of a strict JSON text, null for others: repeated keys, NaN, and anything after the value are refused.

    The parser reads one value and leaves what follows. So the text is read as the one item of a list and as the one member of
    an object: what could end the first can't end the second. Half a surrogate pair becomes a question mark; texts that nest deeper, or
    are longer, than a variant allows are refused.
    """
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(item.isNotNull(), F.try_variant_get(member, "$.x", "variant"))


def encode(value: Any, form: str) -> str:
    return json.dumps(value, **FORMS[form])


def digest(value: Any, form: str) -> str:
    """SHA-256 of the UTF-8 of an encoding."""
    return hashlib.sha256(encode(value, form).encode()).hexdigest()


def parsed(text: Column, form: str = "binding") -> Column:
    """struct(ok, error, canonical, sha256) of JSON texts; a null text is not ok."""

    @F.pandas_udf("ok boolean, error string, canonical string, sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                if t is None:
                    raise NotStrict("no text")
                told = encode(strict_loads(t), form)
                rows.append((True, None, told, hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest()))
            except ValueError as e:
                rows.append((False, str(e), None, None))
        return pd.DataFrame(rows, columns=["ok", "error", "canonical", "sha256"])

    return run(text)
