"""Content-defined anchors of all fixed-length windows of many texts at once (numpy).

The anchor of a window is the smallest hash among the grams that it contains.
Equal windows have equal anchors wherever they occur, and neighbouring windows
mostly share theirs, so windows are handled in runs with one anchor.
"""

from __future__ import annotations

import numpy as np

from rillet.llm.shingles import mix64

#: Length of a gram in bytes (a power of two).
GRAM = 32
#: Most windows in a run; longer runs (periodic text) are cut.
MAX_RUN = 1024


def gram_hashes(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the gram at each position where one fits."""
    h = raw.astype(np.uint64) + np.uint64(1 + seed)
    base, width = 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    return mix64(h ^ np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64)))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done, m = 1, h
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[: h.size - width + 1], m[width - done:][: h.size - width + 1])


def window_anchors(raw: np.ndarray, window: int, seed: int = 0) -> np.ndarray:
    """The anchor of the window at each position where one fits."""
    return _sliding_min(gram_hashes(raw, seed), window - GRAM + 1)


def runs(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """``(start, n_windows, anchor, repeats)`` of all runs of windows in texts laid end to end.

    ``ends`` are the ends of the texts in ``raw``; no window crosses one.  ``repeats``: the anchor's gram occurs
    more than once in the run's bytes, so that equal windows within the run cannot be ruled out.
    """
    if raw.size < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool)
    h = gram_hashes(raw)
    anchor = _sliding_min(h, window - GRAM + 1)
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(anchor.size + 1, np.int8)
    long = ends - begins >= window
    inside[begins[long]] += 1
    stop = np.minimum(ends[long] - window + 1, anchor.size)
    np.subtract.at(inside, stop, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.empty(anchor.size, bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[1:] |= ~inside[:-1]
    new[begins[long]] = True
    start = np.flatnonzero(new & inside)
    # A run ends at the next start, or where windows no longer fit.
    cut = np.flatnonzero(new | ~inside)
    after = np.searchsorted(cut, start, "right")
    end = np.where(after < cut.size, cut[np.minimum(after, cut.size - 1)], anchor.size)
    size = end - start
    if (size > MAX_RUN).any():
        parts = -(-size // MAX_RUN)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        at = (np.arange(parts.sum()) - first) * MAX_RUN
        start, size = np.repeat(start, parts) + at, np.minimum(np.repeat(size, parts) - at, MAX_RUN)
    value = anchor[start]
    reach = size + window - GRAM  # grams in the run's bytes
    first = np.cumsum(reach) - reach
    place = np.arange(reach.sum()) + np.repeat(start - first, reach)
    same = h[place] == np.repeat(value, reach)
    return start, size, value, np.add.reduceat(same, first, dtype=np.int64) > 1
