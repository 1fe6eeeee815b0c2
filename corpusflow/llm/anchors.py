"""Anchors of byte windows: every 50-byte window has one, equal windows have equal ones."""

from __future__ import annotations

import numpy as np

from corpusflow.llm import common

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A hash per byte value.
_BYTES = common.mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all byte ranges of ``size``; sums of shifted halves, so work grows with log(size)."""
    have, width = _BYTES[data], 1
    out, done = None, 0
    while True:
        if size & width:
            # ranges of `done` bytes followed by ranges of `width` bytes
            if out is None:
                out = have.copy()
            else:
                m = len(have) - done
                out = out[:m] * _power(width) + have[done : done + m]
            done += width
        width *= 2
        if width > size:
            break
        m = len(have) - width // 2
        if m <= 0:
            return np.zeros(0, np.uint64)
        have = have[:m] * _power(width // 2) + have[width // 2 :]
    n = max(0, len(data) - size + 1)
    return common.mix(out[:n])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), n, 1 << 64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` values in a row."""
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def window_groups(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: text, first window, number of windows, anchor.

    The anchor of a window is the smallest hash among its grams. ``first`` is a place in ``data``. Windows never cross texts.
    """
    n = len(data) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    low = sliding_min(gram_hashes(data, gram), window - gram + 1)
    begins = np.ones(n + 1, bool)
    np.not_equal(low[1:], low[:-1], out=begins[1:-1])
    # windows of a text begin with it and end ``window`` bytes before it ends
    starts, ends = offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1])
    begins[starts[starts < n]] = True
    begins[ends[ends < n]] = True
    first = np.flatnonzero(begins)
    first, counts = first[:-1], np.diff(first)
    text = np.searchsorted(offsets, first, side="right") - 1
    inside = first < ends[text]
    return text[inside], first[inside], counts[inside], low[first[inside]]
