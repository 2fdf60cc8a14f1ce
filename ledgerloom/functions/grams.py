"""Hashes of byte grams, few of a text, of which every passage of some length holds at least one."""

from __future__ import annotations

import numpy as np

#: By width of a passage: bytes of a gram and grams of a window; a passage of the width has one whole window.
GRAMS = {1: (1, 1), 2: (2, 1), 4: (4, 1), 8: (8, 1), 16: (8, 9), 32: (16, 17), 64: (32, 33)}
WIDEST = max(GRAMS)
#: Bytes that are hashed at once.
STRETCH = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)


def _least(part: np.ndarray, width: int) -> np.ndarray:
    gram, window = GRAMS[width]
    h, size = _mix(part.astype(np.uint64) + np.uint64(1)), 1
    while size < gram and len(h):
        h, size = _mix(h[:-size] * np.uint64(0xA24BAED4963EE407) + h[size:]), 2 * size
    size = 1
    while 2 * size <= window and len(h):
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    if size < window and len(h):
        h = np.minimum(h[: -(window - size)], h[window - size :])
    return np.unique(h)


def grams(data: bytes, width: int) -> np.ndarray:
    """The least hash of each window of a text, once: whatever passage of `width` bytes or more it holds, the
    passage's own are among them. A text shorter than that has none."""
    if len(data) < width:
        return np.zeros(0, np.int64)
    whole = np.frombuffer(data, np.uint8)
    # Stretches share what a passage of the width may need of both.
    parts = [_least(whole[at : at + STRETCH + WIDEST - 1], width) for at in range(0, max(1, len(whole) - WIDEST + 1), STRETCH)]
    return np.unique(np.concatenate(parts)).view(np.int64)


def width_of(size: int) -> int:
    """The widest of GRAMS that a passage of so many bytes has."""
    return 1 << min(size, WIDEST).bit_length() - 1
