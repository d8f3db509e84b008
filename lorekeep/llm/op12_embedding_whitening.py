"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Entries become integers x = floor(scale * c) (``scale`` 256).  The fit list is each distinct vector once: n of them
with sums S.  Tasks sum the products of their rows exactly; the sums meet by matrix row.  The
scatter M = n * sum(x x') - S S' = n^2 V is an integer matrix, of which tasks compute the characteristic
polynomial modulo primes by Hessenberg reduction, a share of the primes each; one prime more than needed checks
the Chinese remainders.  The driver, whose work depends on the dimension alone and not on the rows, isolates the
largest roots in integers to 128 bits and finds their vectors by inverse iteration in fixed point of 320
bits (``charpoly``).  Rows are projected as (n x - S) . u / sqrt(root of M), in doubles, with
n x - S exact.

Defined results: rows whose vector is null, empty, or holds a null, an infinity or no number
are left out; unequal lengths among the others are an error.  Repeated rows and equal vectors count once in the fit
and each have their rows in the result; a null vec_id is kept.  Roots of 0 have no whitened value: components
are those of a positive root, 4 at most (none if all vectors are equal: then no rows).  Of equal
roots the vectors are an orthonormal basis of their space.  An empty table gives an empty table.  Other
columns are not read, whatever their names.  A deviation beyond 64 bits is an error, never wrapped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charpoly
from .tables import arrow_map, materialise

SCALE, COMPONENTS = 256, 4
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of integers) of the rows whose vectors are whole."""
    c = embeddings[vector].cast("array<double>")
    whole = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), c.alias("c"), whole.alias("whole")).where("whole")
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * scale).cast("bigint")).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch as rows."""
    width = np.diff(column.offsets.to_numpy())
    if len(width) and (width != width[0]).any():
        raise ValueError("vectors of unequal lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(width), -1)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x exactly: in doubles where no sum reaches 2**53, in integers where none reaches 2**63, else in Python's."""
    most = max(int(x.max()), -int(x.min()), 1)
    if len(x) * most * most < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    x = x if len(x) * most * most < 1 << 63 else x.astype(object)
    return x.T @ x


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and M = n * sum(x x') - S S' of the distinct vectors (column ``x``), exactly."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.slice(i, 4096).column("x"))
                x = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
                own = _products(x).astype(object)  # Python's integers: sums over a task have no bound
                if total is not None and total.shape != own.shape:
                    raise ValueError("vectors of unequal lengths")
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": np.arange(len(total), dtype=np.int32), "sums": [[str(v) for v in r] for r in total]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, sums in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                own = np.array([int(v) for v in sums], dtype=object)
                if row in held and len(held[row]) != len(own):
                    raise ValueError("vectors of unequal lengths")
                held[row] = held[row] + own if row in held else own
        if held:
            yield pa.RecordBatch.from_pydict({"row": pa.array(held, pa.int32()), "sums": [[str(v) for v in r] for r in held.values()]})

    schema = "row int, sums array<string>"
    rows = fit.select("x").mapInArrow(partial, schema).repartition("row").mapInArrow(added, schema).collect()  # d + 1 rows
    if not rows:
        return 0, [], []
    g = [[int(v) for v in r.sums] for r in sorted(rows, key=lambda r: r.row)]
    if len({len(g), *map(len, g)}) > 1:
        raise ValueError("vectors of unequal lengths")
    n, s = g[-1][-1], g[-1][:-1]
    return n, s, [[n * v - a * b for v, b in zip(row, s, strict=False)] for row, a in zip(g, s, strict=False)]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - m), constant first, of a positive semidefinite integer matrix: the primes are dealt to tasks."""
    ps = charpoly.primes(charpoly.primes_needed(m) + 1)
    held = spark.sparkContext.broadcast([[str(v) for v in row] for row in m])  # its size depends on the dimension alone
    step = max(1, min(64, (1 << 22) // len(m) ** 2))  # primes at once

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        own = [[int(v) for v in row] for row in held.value]
        mine = batch.column("p").to_pylist()
        for i in range(0, len(mine), step):
            yield {"p": mine[i : i + step], "c": charpoly.modular_polynomials(own, mine[i : i + step]).tolist()}

    dealt = spark.createDataFrame([(p,) for p in ps], "p bigint").repartition(max(1, min(len(ps) // 8, spark.sparkContext.defaultParallelism)))
    of = {r.p: r.c for r in arrow_map(dealt, run, "p bigint, c array<bigint>").collect()}  # bounded: primes and degree
    poly = charpoly.combine(np.array([of[p] for p in ps[:-1]]), ps[:-1])
    if [c % ps[-1] for c in poly] != of[ps[-1]]:
        raise ArithmeticError("the remainders don't agree on a polynomial")
    return poly


def principal_components(spark: SparkSession, m: list[list[int]], count: int = COMPONENTS) -> list[tuple[float, float, list[float]]]:
    """(square root of the root of m, its share of the trace, unit vector) by falling root; positive roots only."""
    poly, trace = characteristic_polynomial(spark, m), sum(m[i][i] for i in range(len(m)))
    out = []
    for low, high, bits, many in charpoly.largest_roots(poly, trace, count):
        root = isqrt(((low + high) << 128) >> bits + 1) / (1 << 64)
        share = ((low + high) << 64) // (trace << bits + 1) / (1 << 64)
        for v in charpoly.null_vectors(m, low, high, bits, many, count - len(out)):
            out.append((root, share, [c / (1 << charpoly.FIXED) for c in v]))
    return out


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S exactly."""
    most = n * max(int(x.max()), -int(x.min()), 1) + max(map(abs, s))
    return n * x.astype(np.int64 if most < 1 << 62 else object) - np.array(s, dtype=np.int64 if most < 1 << 62 else object)


def _deviations(d: np.ndarray) -> list[int]:
    most = max(int(d.max()), -int(d.min()), 1)
    out = (d * d if d.shape[1] * most * most < 1 << 63 else d.astype(object) ** 2).sum(axis=1).tolist()
    if max(out) >= 1 << 63:
        raise OverflowError("a deviation takes more than 64 bits")
    return out


def whitened(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each whole vector and component."""
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings, vector, scale)
    fit = materialise(rows.select("x").distinct(), "fit")
    n, s, m = scatter(fit)
    found = principal_components(spark, m, count) if n and any(m[i][i] for i in range(len(m))) else []
    if not found:
        return spark.createDataFrame([], SCHEMA)
    basis = np.array([u for _, _, u in found]).T / np.array([r for r, _, _ in found])
    shares, k = [e for _, e, _ in found], len(found)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                w = _centred(_matrix(batch.slice(i, 4096).column("x")), n, s).astype(np.float64) @ basis
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": np.arange(k * (k + 1), dtype=np.int32), "v": np.concatenate([first, second.ravel()])})

    sums = {r.i: r.v for r in fit.mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}  # k * (k + 1) rows
    mean = np.array([sums[i] for i in range(k)]) / n
    cov = np.array([sums[k + i] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs(cov - np.eye(k)).max())

    def project(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            d = _centred(_matrix(part.column("x")), n, s)
            times = np.repeat(np.arange(part.num_rows), k)
            yield {
                "vec_id": part.column("vec_id").take(pa.array(times)),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows),
                "n": np.full(len(times), n),
                "deviation": np.repeat(np.array(_deviations(d)), k),
                "whitened": (d.astype(np.float64) @ basis).ravel(),
                "explained": np.tile(shares, part.num_rows),
                "identity_error": np.full(len(times), error),
            }

    return arrow_map(rows, project, SCHEMA)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four largest components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
