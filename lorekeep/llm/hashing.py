"""Vectorised hashing of words, shingles and character k-mers with numpy.

All functions work on one text at a time and are pure: equal input bytes give
equal hashes on every executor.  Hashes are 64-bit polynomial hashes with a
final avalanche step.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: ASCII white space: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space, and ASCII punctuation and controls: all but letters, digits and bytes of non-ASCII characters.
IS_NO_LETTER = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 14)
            if size > 1 << 22:  # very long texts: don't keep the tables
                return _powers(_BASE, size), _powers(_BASE_INV, size)
            self.up, self.down = _powers(_BASE, size), _powers(_BASE_INV, size)
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _Powers()


def spans(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``is_gap`` is false."""
    inside = np.zeros(len(is_gap) + 2, dtype=np.int8)
    np.logical_not(is_gap, out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def range_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal ranges give equal hashes wherever they stand."""
    up, down = _POWERS.get(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def words(text: str, lower: bool = True, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes (A-Z lowered), and starts, ends and hashes of the words ``[^\\x20\\x09-\\x0D]+`` (or between other gaps)."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if lower:
        b = _LOWER[b]
    starts, ends = spans(gaps[b])
    return b, starts, ends, range_hashes(b, starts, ends)


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; with fewer words, the whole sequence as one."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    acc = word_hashes[: n - k + 1].copy()
    for j in range(1, k):
        acc *= U64(_BASE)
        acc += word_hashes[j : n - k + 1 + j]
    return mix(acc + U64(k))


def kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k values; with fewer values, the whole sequence as one."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=U64)
    k = min(k, n)
    acc, width = mix(codes.astype(U64) + U64(1)), 1
    out, done = None, 0
    base = _BASE
    while True:  # doubling windows
        if k & width:
            if out is None:
                out, done = acc, width
            else:
                m = n - done - width + 1
                out = out[:m] * U64(pow(_BASE, width, 1 << 64)) + acc[done : done + m]
                done += width
        if done == k:
            return mix(out[: n - k + 1])
        m = n - 2 * width + 1
        acc = acc[:m] * U64(base) + acc[width : width + m]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        width *= 2
