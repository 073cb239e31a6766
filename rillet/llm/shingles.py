"""Word shingles and minhashes of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

#: Fixed value: bytes that part words (space, tab to carriage return).
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
#: Entries of the power tables that a worker keeps (16 MB).
_KEPT = 1 << 20
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if n <= _powers.size:
        return _powers, _inverse
    size = max(n, _KEPT)
    tables = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    for table in tables:
        table[0] = 1
        np.cumprod(table, out=table)
    if n <= _KEPT:  # tables for a longer text are made for it alone
        _powers, _inverse = tables
    return tables


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of the texts, and the number of words of each text."""
    joined = b"\n".join(texts).translate(_LOWER)
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(joined, np.uint8)
    gap = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    powers, inverse = _power_tables(raw.size + 1)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: raw.size], out=sums[1:])
    words = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    sizes = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return words, np.diff(bounds)


def shingle_sets(texts: list[bytes], n_words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n_words``-word shingles; the whole sequence is the only
    shingle of a text with fewer words, and a text without words has none."""
    words, counts = word_hashes(texts)
    shingles = np.zeros(words.size, np.uint64)
    if words.size >= n_words:
        n = words.size - n_words + 1
        acc = np.full(n, n_words, np.uint64)
        for k in range(n_words):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + words[k: k + n])
        shingles[:n] = acc
    out, at = [], 0
    for count in counts.tolist():
        if count >= n_words:
            out.append(np.unique(shingles[at: at + count - n_words + 1]))
        elif count:
            acc = np.full(1, count, np.uint64)
            for k in range(count):
                acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + words[at + k: at + k + 1])
            out.append(acc)
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity of the values that fall on each bit, 4 to 8 bits a value (a power of two, two words or more)."""
    n_bits = max(128, 1 << int(4 * values.size - 1).bit_length()) if values.size else 128
    counts = np.bincount((mix64(values) & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def minhashes(sets: list[np.ndarray], n: int, seed: int = 7) -> np.ndarray:
    """``n`` minhashes of each non-empty set (rows)."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]])
    out = np.empty((len(sets), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(flat * factor[k] + shift[k], starts)
    return out
