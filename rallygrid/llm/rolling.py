"""Hashes of words and of runs of words, by whole arrays.

A run's hash is a difference of prefix sums, so it costs the same for any
length.  Arithmetic wraps at 64 bits; multipliers are odd and so have inverses.
"""
from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text hashed at once.
BLOCK = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))


class Powers:
    """Powers of a base and of its inverse, as far as asked for yet."""

    def __init__(self, base: int):
        self.steps = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            up, down = (np.uint64(pow(s, k, 1 << 64)) for s in self.steps)
            self.up, self.down = np.concatenate([self.up, self.up * up]), np.concatenate([self.down, self.down * down])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(_BYTE_BASE), Powers(_WORD_BASE)


def _prefix(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~BLANK[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of a text."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    out, done = np.zeros(len(starts), np.uint64), 0
    while done < len(starts):  # whole words, about a block of bytes at a time
        last = max(done + 1, int(np.searchsorted(ends, starts[done] + BLOCK)))
        low = int(starts[done])
        a, b = starts[done:last] - low, ends[done:last] - low
        sums, down = _prefix(_BYTE[data[low:int(ends[last - 1])]], _BYTES)
        out[done:last] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(_WORD_BASE))
        done = last
    return out, starts, ends


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums, down = _prefix(words, _WORDS)
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; a shorter text is one run of all its words, none has none."""
    words = word_hashes(text)[0]
    return np.unique(run_hashes(words, min(k, len(words)))) if len(words) else words
