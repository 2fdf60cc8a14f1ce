"""Configuration files with variables, and limits that must be finite and above zero."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Mapping
from typing import Any

from ..functions.canonical import strict_loads

_NAME = re.compile(r"\$(?:(\w+)|\{(\w+)\})")


def expanded(value: Any, known: Mapping[str, str] | None = None) -> Any:
    """A tree with $NAME, ${NAME} and a leading ~ put in; an unknown name is an error."""
    known = os.environ if known is None else known
    if isinstance(value, str):
        told = _NAME.sub(lambda m: known[m[1] or m[2]], value)
        return known.get("HOME", "~") + told[1:] if told == "~" or told.startswith("~/") else told
    if isinstance(value, dict):
        return {k: expanded(v, known) for k, v in value.items()}
    return [expanded(v, known) for v in value] if isinstance(value, list) else value


def limits(config: dict, names: tuple[str, ...]) -> dict[str, float]:
    """The named limits; ValueError for one that is missing, no number, not finite or not above zero."""
    found = {n: config.get(n) for n in names}
    wrong = [n for n, v in found.items() if type(v) not in (int, float) or not math.isfinite(v) or v <= 0]
    if wrong:
        raise ValueError(f"limits must be finite and above zero: {', '.join(wrong)}")
    return found


def load(path: str, names: tuple[str, ...] = (), known: Mapping[str, str] | None = None) -> dict:
    """A strict JSON object from a file, expanded, with its limits checked."""
    with open(path, encoding="utf-8") as f:
        config = expanded(strict_loads(f.read()), known)
    if not isinstance(config, dict):
        raise ValueError("a configuration is an object")
    limits(config.get("limits", {}), names)
    return config
