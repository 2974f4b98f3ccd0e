"""Word hashes of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _WORD[ord(_a) : ord(_b) + 1] = True

_STEP = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 2**64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def folded(flat: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    out = _LOWER[flat]
    if len(flat) > 1:
        second = np.flatnonzero(flat[:-1] == 0xC3) + 1
        upper = second[(flat[second] >= 0x80) & (flat[second] <= 0x9E) & (flat[second] != 0x97)]
        out[upper] += 32
    return out


def spans(is_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the runs of word bytes, cut at the ends of texts, and the offset of each text's first word."""
    inside = np.concatenate([[False], is_word, [False]])
    begins = inside[1:] & ~inside[:-1]
    edge = off[1:-1]
    edge = edge[edge < len(is_word)]
    begins[edge] |= is_word[edge]
    start = np.flatnonzero(begins[:-1])
    ends = ~inside[1:] & inside[:-1]
    cut = edge[edge > 0]
    ends[cut] |= is_word[cut - 1]
    return start, np.flatnonzero(ends), np.searchsorted(start, off)


def hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes that depends on its content only."""
    up, down = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lower case) of texts laid end to end, and each text's offset."""
    low = folded(flat)
    start, end, first = spans(_WORD[low], off)
    return hashes(low, start, end), first
