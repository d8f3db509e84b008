"""Exact characteristic polynomials of integer matrices, their real roots and eigenvectors.

The polynomial is computed modulo many primes by Hessenberg reduction (``modular_polynomials``) and put
together by Chinese remainders.  All roots of a symmetric matrix are real, and for such a polynomial
Descartes' rule is exact: the number of roots above a, with multiplicity, is the number of sign
changes of the polynomial shifted by a.  Bisection on that count isolates roots to any precision in
integer arithmetic.  Eigenvectors come from inverse iteration on the null space of M - mu in
fixed-point integers.
"""

from __future__ import annotations

import numpy as np

#: Bits after the point in inverse iteration, and bits to which a root is isolated.
FIXED, ROOT_BITS = 320, 128


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The ``count`` largest primes below a bound up to 2**31."""
    out, p = [], below - 1 | 1
    while len(out) < count:
        if p < 3:
            raise ValueError(f"fewer than {count} odd primes below {below}")
        if _is_prime(p):
            out.append(p)
        p -= 2
    return out


def _is_prime(n: int) -> bool:
    for q in (2, 3, 5, 7):  # bases that decide below 3,215,031,751
        if n % q == 0:
            return n == q
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def modular_polynomials(m: list[list[int]], ps: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(x - m) modulo each prime, a row for each."""
    d, p = len(m), np.array(ps, dtype=np.int64)
    flat = [x for row in m for x in row]
    h = np.array([[x % q for x in flat] for q in ps], dtype=np.int64).reshape(len(ps), d, d)
    mod, all_ = p[:, None, None], np.arange(len(ps))
    for k in range(1, d - 1):
        # a pivot below the diagonal for each prime; where there is none the column is reduced already
        at = k + (h[:, k:, k - 1] != 0).argmax(axis=1)
        h[all_, k], h[all_, at] = h[all_, at], h[all_, k].copy()
        h[all_, :, k], h[all_, :, at] = h[all_, :, at], h[all_, :, k].copy()
        inverse = np.array([pow(int(x), -1, q) if x else 0 for x, q in zip(h[:, k, k - 1], ps, strict=True)], dtype=np.int64)
        u = h[:, k + 1 :, k - 1] * inverse[:, None] % p[:, None]
        h[:, k + 1 :] = (h[:, k + 1 :] - u[:, :, None] * h[:, k : k + 1] % mod) % mod
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1 :] * u[:, None, :] % mod).sum(axis=2)) % p[:, None]
    # det of the leading k x k blocks of x - h
    poly = np.zeros((d + 1, len(ps), d + 1), dtype=np.int64)
    poly[0, :, 0] = 1
    col = p[:, None]
    for k in range(1, d + 1):
        now = -h[:, k - 1, k - 1, None] * poly[k - 1] % col
        now[:, 1:] += poly[k - 1][:, :-1]
        below = np.ones(len(ps), dtype=np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            now -= (h[:, i - 1, k - 1] * below % p)[:, None] * poly[i - 1] % col
        poly[k] = now % col
    return poly[d]


def combine(residues: np.ndarray, ps: list[int]) -> list[int]:
    """Integers of least size with the given residues (a row for each prime)."""
    total, out = 1, [0] * residues.shape[1]
    for row, p in zip(residues.tolist(), ps, strict=True):
        inverse = pow(total, -1, p)
        out = [x + total * ((r - x) * inverse % p) for x, r in zip(out, row, strict=True)]
        total *= p
    return [x - total if 2 * x > total else x for x in out]


def primes_needed(m: list[list[int]]) -> int:
    """Primes whose product exceeds twice every coefficient, for a positive semidefinite matrix: coefficient k is at most C(d, k) (trace / d)^k."""
    d = len(m)
    bound = 2 * (sum(m[i][i] for i in range(d)) // d + 2) ** d
    return bound.bit_length() // 30 + 1  # the primes in use are far above 2**30


def roots_above(poly: list[int], at: int) -> int:
    """Roots above ``at``, with multiplicity, of a polynomial whose roots are all real: sign changes of its coefficients after the shift."""
    c = list(poly)
    if at:
        for i in range(len(c) - 1):
            acc = c[-1]
            for j in range(len(c) - 2, i - 1, -1):
                acc = c[j] + at * acc
                c[j] = acc
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _is_above(poly: list[int], at: int, found: int) -> bool:
    """Whether root number ``found`` + 1, a single one between those before and the next, is above ``at``: by the sign there."""
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return value != 0 and (value < 0) == (found % 2 == 0)


def largest_roots(poly: list[int], bound: int, count: int) -> list[tuple[int, int, int, int]]:
    """The ``count`` largest positive roots as (low, high, bits, multiplicity): multiplicity roots lie in (low, high] / 2**bits, of which all have ``ROOT_BITS`` bits or more."""
    bits = max(0, ROOT_BITS + 2 - bound.bit_length())
    d = len(poly) - 1
    scaled = [x << bits * (d - i) for i, x in enumerate(poly)]  # its roots are 2**bits as large
    out: list[tuple[int, int, int, int]] = []
    found, top = 0, bound + 1 << bits
    positive = roots_above(scaled, 0)
    while found < min(count, positive):
        low, high, below = 0, top, positive  # below: roots above low; above high there are ``found``
        while high - low > max(1, high >> ROOT_BITS):
            mid = (low + high) // 2
            # a single root in the interval shows by the sign alone
            n = roots_above(scaled, mid) if below != found + 1 else found + _is_above(scaled, mid, found)
            if n > found:
                low, below = mid, n
            else:
                high = mid
        n = below
        out.append((low, high, bits, n - found))
        found, top = n, low
    return out


def null_vectors(m: list[list[int]], low: int, high: int, bits: int, many: int, keep: int) -> list[list[int]]:
    """Orthonormal eigenvectors (fixed point) for ``many`` roots of a symmetric matrix in (low, high] / 2**bits; the first ``keep`` of them.

    Elimination is done once; two rounds of inverse iteration follow for each vector, each made orthogonal to those before.
    """
    d = len(m)
    one = 1 << FIXED
    # the matrix over the root, so that entries are near 1; the shift is the middle of the interval
    size = max(low + high, 1)
    x = [[(v << FIXED + bits + 1) // size for v in row] for row in m]
    for i in range(d):
        x[i][i] -= one
    a, order, tiny = np.array(x, dtype=object), list(range(d)), 1 << FIXED // 4
    for k in range(d):
        at = max(range(k, d), key=lambda i: abs(a[i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            order[k], order[at] = order[at], order[k]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << FIXED) // a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :]) >> FIXED
    out: list[np.ndarray] = []
    for v in range(min(many, keep)):
        y = np.array([one // (1 + (i * (2 * v + 7) + v) % (d + 3)) * (-1 if (i * i + v * i) % 3 == 1 else 1) for i in range(d)], dtype=object)
        for _ in range(3):
            y = y[order]
            for i in range(1, d):
                y[i] -= int(a[i, :i] @ y[:i]) >> FIXED
            for i in range(d - 1, -1, -1):
                y[i] = (int(y[i] - ((int(a[i, i + 1 :] @ y[i + 1 :]) if i + 1 < d else 0) >> FIXED)) << FIXED) // a[i, i]
            y = _unit(y)
            for z in out:
                y = y - (z * (int(y @ z) >> FIXED) >> FIXED)
            y = _unit(y)
        out.append(y)
    return [[int(c) for c in y] for y in out]


def _unit(y: np.ndarray) -> np.ndarray:
    from math import isqrt

    # a short vector gets more bits first
    longest = max(int(abs(c)).bit_length() for c in y)
    if longest < 2 * FIXED:
        y = y * (1 << 2 * FIXED - longest)
    return (y << FIXED) // isqrt(int(y @ y))
