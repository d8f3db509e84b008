"""HyperMinHash sketches: registers of leading-zero counts plus mantissa bits.

A set of 64-bit hashes goes to ``2**P`` buckets by its top bits.  A bucket keeps
its smallest remaining hash as a 16-bit register: the count of leading zeros
(6 bits) and the ``R`` bits after the leading one (10 bits).  0 is empty.
"""

from __future__ import annotations

import numpy as np

from .hashing import U64, mix

P, R = 8, 10
BUCKETS = 1 << P


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """Registers of a set given as ascending distinct hashes."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if len(sorted_hashes) == 0:
        return out
    bucket = (sorted_hashes >> U64(64 - P)).astype(np.intp)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (sorted_hashes[first] << U64(P)) >> U64(P) | U64(1)
    zeros = (64 - P - 1) - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 64 - P - 1 - R)
    shift = (64 - P - 1 - R - zeros).astype(U64)
    mantissa = (rest >> shift) & U64((1 << R) - 1)
    out[bucket[first]] = ((zeros + 1).astype(np.uint16) << np.uint16(R)) | mantissa.astype(np.uint16)
    return out


def densified(regs: np.ndarray) -> np.ndarray:
    """Rows of registers with each empty one lent the next non-empty register of its row, around the end."""
    n = regs.shape[1]
    twice = np.concatenate([regs, regs], axis=1) != 0
    at = np.where(twice, np.arange(2 * n), 2 * n)
    donor = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :n] % n
    return np.take_along_axis(regs, donor, axis=1)


def band_positions(bands: int, rows: int) -> np.ndarray:
    """Which registers each band takes: ``rows`` different ones, dealt in rounds over all buckets."""
    deals = -(-bands * rows // BUCKETS) + 1
    order = np.concatenate([np.argsort(mix(np.arange(BUCKETS, dtype=U64) + U64(0xBA4D + 977 * d))) for d in range(deals)])
    per = BUCKETS // rows
    return np.stack([order[(i // per) * BUCKETS + (i % per) * rows :][:rows] for i in range(bands)])


def band_keys(regs: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """For each row of registers one 64-bit key per band; equal keys make two sets candidates."""
    dense = densified(regs)
    acc = np.broadcast_to(np.arange(1, len(positions) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(regs), len(positions)))
    for j in range(positions.shape[1]):
        acc = mix(acc + dense[:, positions[:, j]].astype(U64) + U64(1))
    return acc.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the registers in use.

    Different minima share a register with a small probability; the expected
    number of such accidents for sets of sizes ``n_a`` and ``n_b`` is taken off
    the number of equal registers.
    """
    used = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    accidents = 0.169919487159739 * 2.0 ** (P - R) * 4 * ratio / (1 + ratio) ** 2
    accidents = accidents * ((a != 0) & (b != 0)).sum(axis=1) / BUCKETS
    return np.clip(equal - accidents, 0, None) / np.maximum(used, 1), used
