"""Classes of equal fixed-length strings of a text, by interval expansion on its Burrows-Wheeler transform (numpy).

Intervals of the transform stand for strings.  Breadth-first backward extension
visits strings by increasing length; the first string to end at a place of the
suffix order gives the common prefix of the suffixes on either side.  Expansion
stops at the length asked for: places still without a value have a longer common
prefix, and suffixes between two places with a value begin with one string.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes in order (prefix doubling from 5 symbols until no two are equal)."""
    n = text.size
    padded = np.concatenate([text, np.zeros(5, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key << np.uint64(8) | padded[k: k + n]
    done = 5
    bits = max(int(n).bit_length(), 1)
    packed = 3 * bits + 1 <= 64 and 40 + bits <= 64
    while True:
        if packed:  # sort key and place together
            both = np.sort(key << np.uint64(bits) | np.arange(n, dtype=np.uint64))
            order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
            sorted_key = both >> np.uint64(bits)
        else:
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
        rank_sorted = np.zeros(n, np.uint64)
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=rank_sorted[1:], dtype=np.uint64)
        rank = np.empty(n, np.uint64)
        rank[order] = rank_sorted
        if int(rank_sorted[-1]) == n - 1:
            return order
        ahead = np.zeros(n, np.uint64)  # 0: past the end
        ahead[: n - done] = rank[done:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + ahead if not packed else rank << np.uint64(bits) | ahead
        done *= 2


def _first_of_each_run(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], values[1:] != values[:-1]])


def prefix_boundaries(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, boundary)``: the suffixes in order, and for each place whether its suffix and the one before have
    a common prefix shorter than ``length``.  ``text`` holds symbols 1 … 254."""
    order = np.concatenate([[text.size], suffix_order(text)])  # the empty suffix comes first
    n = order.size
    transform = np.where(order > 0, text[order - 1], 0).astype(np.uint8)  # 0: the end mark, before the first symbol
    by_symbol = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int64)  # place of the suffix one symbol longer
    back[by_symbol] = np.arange(n)

    new_run = _first_of_each_run(transform)
    run_start = np.flatnonzero(new_run)
    run_end = np.append(run_start[1:], n)
    run_of = np.cumsum(new_run) - 1
    run_symbol = transform[run_start]
    n_runs = run_start.size
    same = np.argsort(run_symbol, kind="stable")
    joined = run_symbol[same][1:] == run_symbol[same][:-1]
    before = np.full(n_runs, -1)
    after = np.full(n_runs, n_runs)
    before[same[1:][joined]] = same[:-1][joined]
    after[same[:-1][joined]] = same[1:][joined]

    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):  # strings of this length are extended to the left
        if not lo.size:
            break
        first_run, last_run = run_of[lo], run_of[hi - 1]
        one = first_run == last_run  # one symbol precedes all of the interval
        new_lo, new_hi = [back[lo[one]]], [back[hi[one] - 1] + 1]
        many = ~one
        if many.any():
            a, z, left, right = first_run[many], last_run[many], lo[many], hi[many]
            size = z - a + 1
            at = np.cumsum(size) - size
            run = np.arange(size.sum()) + np.repeat(a - at, size)
            owner = np.repeat(np.arange(a.size), size)
            begins = before[run] < a[owner]  # the first run of its symbol in the interval
            ends = after[run] > z[owner]
            low = back[np.maximum(run_start[run[begins]], left[owner[begins]])]
            high = back[np.minimum(run_end[run[ends]], right[owner[ends]]) - 1] + 1
            # Within an interval, places grow with the symbol: sorting pairs each first with its last.
            low = np.sort(owner[begins] * (n + 1) + low)
            high = np.sort(owner[ends] * (n + 1) + high)
            new_lo.append(low % (n + 1))
            # An end of n + 1 does not occur: ends are at most n.
            new_hi.append(high - low // (n + 1) * (n + 1))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~boundary[hi]
        boundary[hi] = True
        lo, hi = lo[fresh], hi[fresh]
    return order, boundary[:n]


def string_classes(text: np.ndarray, length: int) -> np.ndarray:
    """A number for each position: equal for positions where the same ``length`` symbols begin (positions nearer
    to the end than that are told apart by what is left)."""
    if not text.size:
        return np.zeros(0, np.int64)
    order, boundary = prefix_boundaries(text, length)
    classes = np.empty(order.size, np.int64)
    classes[order] = np.cumsum(boundary)
    return classes[:-1]
