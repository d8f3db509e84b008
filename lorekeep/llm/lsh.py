"""Groups of similar items from band keys and sketches, with bounded work in every bucket.

Items have an id (any orderable type), a set size ``n`` and a fixed-size binary
``sig``.  Items that share a band key are candidates:

* up to ``small`` items in a bucket: all pairs, a constant number for each item;
* beyond: each item against a few pivots.  Items that the confirmed links leave
  in another component than most of their bucket are then compared with the
  rest of it exactly, in blocks of at most ``2 * block`` items: by sketches
  first, then with the full sets of those that have a close pair.

Candidates whose sketches are close are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, by_key, discard, materialise, stars

PIVOTS = 2
#: (sketches, sketches, sizes, sizes) -> whether each pair may be linked
Close = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: sketches -> band keys of each; 0 is no key
Keys = Callable[[np.ndarray], np.ndarray]
#: table of ids -> (id, hashes): full sets as ascending hashes
Sets = Callable[[DataFrame], DataFrame]


def rows_of(column: pd.Series) -> np.ndarray:
    """Binary sketches of one width as rows of 16-bit values."""
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(len(column), -1)


def _estimated(pairs: DataFrame, items: DataFrame, close: Close) -> DataFrame:
    """Those of the (a, b) pairs whose sketches are close."""
    side = lambda x: items.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"r_{x}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 4096):
                p = f.iloc[i : i + 4096]
                yield p.loc[close(rows_of(p.r_a), rows_of(p.r_b), p.n_a.to_numpy(), p.n_b.to_numpy()), ["a", "b"]]

    return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").mapInPandas(run, pairs.schema)


def _buckets(postings: DataFrame) -> DataFrame:
    """The postings of keys that several items share, with their number; counts and postings meet as plain shuffles, of which Spark splits a hot key's partition."""
    counts = by_key(postings, "key", size=F.count(F.lit(1))).where("size > 1")
    return materialise(postings.join(counts.hint("merge"), "key").select("key", "id", "n", "size"), "buckets")


def _first_pairs(shared: DataFrame, small: int, block: int, percent: int) -> DataFrame:
    """Candidates of the first round whose sizes allow a link."""
    fit = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    few = shared.where(F.col("size") <= small)
    side = lambda x: few.select("key", F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & fit("n_a", "n_b")).select("a", "b")
    many = shared.where(F.col("size") > small)
    pivots = many.groupBy("key").agg(F.max("size").alias("size"), *(F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id", "n")).alias(f"p{i}") for i in range(PIVOTS)))
    # a bucket's members are dealt to chunks, and its pivots go to each chunk
    chunks = F.ceil(F.col("size") / block).cast("int")
    spread = pivots.select("key", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), *(f"p{i}" for i in range(PIVOTS)))
    spread = spread.select("key", "chunk", F.explode(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("p")).select("key", "chunk", F.col("p.id").alias("p"), F.col("p.n").alias("n_p")).distinct()
    star = many.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).join(spread.hint("merge"), ["key", "chunk"])
    star = star.where((F.col("p") != F.col("id")) & fit("n_p", "n"))
    return pairs.union(star.select(F.least("p", "id"), F.greatest("p", "id"))).distinct()


def _left_links(many: DataFrame, comps: DataFrame, items: DataFrame, block: int, close: Close, keys_of: Keys, sets_of: Sets, percent: int, width: int) -> DataFrame:
    """Links between components of the first links in which members of large buckets lie: one for each two components in a block."""
    # an item has a fixed number of keys: it meets its component once, not once for each key
    per_item = many.groupBy("id").agg(F.collect_list("key").alias("keys"))
    placed = per_item.join(comps.withColumnRenamed("node", "id").hint("merge"), "id", "left").join(items.select("id", "n", "sig").hint("merge"), "id")
    at = materialise(placed.select(F.explode("keys").alias("key"), "id", F.coalesce("component", "id").alias("comp"), "n", "sig"), "placed")  # read by counts and blocks
    counts = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = by_key(counts, "key", main=F.max_by("comp", F.struct("c", "comp")), n_main=F.max("c"), n_all=F.sum("c")).where("n_main < n_all")
    chunk = lambda n: F.ceil(F.col(n) / block).cast("int")
    dealt = at.join(main.select("key", "main", chunk("n_main").alias("m"), F.ceil((F.col("n_all") - F.col("n_main")) / block).cast("int").alias("s")).hint("merge"), "key").withColumn("stray", F.col("comp") != F.col("main"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("stray"), F.col("s")).otherwise(F.col("m"))).cast("int"))
    # a block pairs one chunk of strays (lo) with one chunk of the main component (hi >= s) or of strays (lo <= hi < s)
    of_stray = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.col("own").alias("lo"), (F.col("s") + j).alias("hi"))),
        F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("lo"), F.greatest(F.col("own"), j).alias("hi"))),
    )
    of_main = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(j.alias("lo"), (F.col("s") + F.col("own")).alias("hi")))
    dealt = dealt.select("key", "id", "comp", "n", "sig", F.explode(F.when(F.col("stray"), of_stray).otherwise(of_main)).alias("blk"), F.when(F.col("stray"), F.col("own")).otherwise(F.col("s") + F.col("own")).alias("own"))
    # written: a block is dealt by itself, not kept where its bucket lies
    dealt = materialise(dealt.select("key", "id", "comp", "n", "sig", F.col("blk.lo").alias("lo"), F.col("blk.hi").alias("hi"), "own"), "dealt")

    def pairs_of(left: pd.DataFrame, right: pd.DataFrame, key: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of ``left`` the rows of ``right`` that it may be linked with, in another component."""
        sig, n, ids, comp = rows_of(right.sig), right.n.to_numpy(), right.id.to_numpy(), right.comp.to_numpy()
        keys = keys_of(sig)
        for k, (r, own_keys, row, c, i) in enumerate(zip(rows_of(left.sig), keys_of(rows_of(left.sig)), left.n, left.comp, left.id, strict=True)):
            ok = (comp != c) & ((ids > i) | (not same)) & (100 * np.minimum(n, row) >= percent * np.maximum(n, row))
            # a pair is looked at in the first bucket that it shares, and nowhere else
            share = (keys[ok] == own_keys) & (own_keys != 0)
            first = share.argmax(axis=1)
            ok[ok] = ~share.any(axis=1) | (own_keys[first] == key)
            if close is not None:
                ok[ok] = close(np.broadcast_to(r, (ok.sum(), len(r))), sig[ok], np.full(ok.sum(), row), n[ok])
            yield k, np.flatnonzero(ok)

    def halves(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
        lo, hi = f.lo.iloc[0], f.hi.iloc[0]
        return f[f.own == lo], f[f.own == hi], lo == hi

    def near(f: pd.DataFrame) -> pd.DataFrame:
        left, right, same = halves(f)
        found = [np.zeros(0, dtype=np.int64)]
        mine = []
        if len(left) and len(right):
            for k, at in pairs_of(left, right, f.key.iloc[0], same):
                if len(at):
                    mine.append(k)
                    found.append(at)
        return pd.DataFrame({"id": pd.concat([left.id.iloc[mine], right.id.iloc[np.unique(np.concatenate(found))]])})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        left, right, same = halves(f)
        a, b, done = [], [], set()
        if len(left) and len(right):
            comp, sets = right.comp.to_numpy(), right.hashes.to_numpy()
            for k, at in pairs_of(left, right, f.key.iloc[0], same):
                c, own = left.comp.iloc[k], left.hashes.iloc[k]
                for start in range(0, len(at), 64):
                    # one link joins two components
                    some = [j for j in at[start : start + 64].tolist() if (c, comp[j]) not in done]
                    for j, is_linked in zip(some, linked_with(own, [sets[j] for j in some], percent, width), strict=True):
                        if is_linked and (c, comp[j]) not in done:
                            done |= {(c, comp[j]), (comp[j], c)}
                            a.append(min(c, comp[j]))
                            b.append(max(c, comp[j]))
        return pd.DataFrame({"a": pd.Series(a, dtype=f.id.dtype), "b": pd.Series(b, dtype=f.id.dtype)})

    kind = items.schema["id"].dataType.simpleString()
    # sketches, where there are any, show which items have a close pair; the full sets of those go to their blocks
    wanted = dealt.select("id") if close is None else dealt.groupBy("key", "lo", "hi").applyInPandas(near, f"id {kind}")
    full = materialise(sets_of(wanted.distinct()), "sets")
    out = materialise(dealt.join(full.hint("merge"), "id").groupBy("key", "lo", "hi").applyInPandas(join, f"a {kind}, b {kind}").distinct(), "links")
    discard(at, dealt, full)
    return out


def linked(x: bytes, y: bytes, percent: int, width: int = 64) -> bool:
    """Whether two sets, as ascending hashes of ``width`` bits, have a Jaccard similarity of ``percent`` or more."""
    a, b = np.frombuffer(x, dtype=f"u{width // 8}"), np.frombuffer(y, dtype=f"u{width // 8}")
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked_with(x: bytes, others: list[bytes], percent: int, width: int = 64) -> np.ndarray:
    """As ``linked``, for one set and each of several."""
    a, kind = np.frombuffer(x, dtype=f"u{width // 8}"), np.dtype(f"u{width // 8}")
    n = np.array([len(y) for y in others], dtype=np.int64) // kind.itemsize
    b = np.frombuffer(b"".join(others), dtype=kind)
    hit = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b if len(a) else np.zeros(len(b), dtype=bool)
    both = np.bincount(np.repeat(np.arange(len(n)), n)[hit], minlength=len(n))
    return 100 * both >= percent * (len(a) + n - both)


def _confirmed(pairs: DataFrame, sets_of: Sets, percent: int, width: int) -> DataFrame:
    """Those of the (a, b) pairs whose full sets reach the threshold."""
    # written, as both sides read it
    full = materialise(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    side = lambda x: full.select(F.col("id").alias(x), F.col("hashes").alias(f"h_{x}"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        mask = pa.array([linked(x.as_buffer(), y.as_buffer(), percent, width) for x, y in zip(batch.column("h_a"), batch.column("h_b"), strict=True)], type=pa.bool_())
        yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

    return arrow_map(pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "h_a", "h_b"), run, pairs.schema)


def groups(items: DataFrame, postings: DataFrame, close: Close | None, keys_of: Keys, sets_of: Sets, percent: int, small: int = 24, block: int = 500, width: int = 64) -> DataFrame:
    """(node, component) for every item that confirmed links join with a smaller one; the others are components of their own.

    ``items``: id, n, sig, one row for each id.  ``postings``: key, id, n.
    Without ``close`` all candidates of fitting sizes are confirmed on their sets,
    whose hashes have ``width`` bits.
    """
    shared = _buckets(postings)
    pairs = _first_pairs(shared, small, block, percent)
    pairs = materialise(pairs if close is None else _estimated(pairs, items, close), "pairs")
    links = materialise(_confirmed(pairs, sets_of, percent, width), "links")
    discard(pairs)
    comps = stars(links)
    discard(links)
    many = shared.where(F.col("size") > small).select("key", "id")
    if not many.isEmpty():
        more = _left_links(many, comps, items, block, close, keys_of, sets_of, percent, width)
        if not more.isEmpty():
            # components that the blocks join
            found, comps = comps, stars(comps.union(more), "node", "component")
            discard(found)
        discard(more)
    discard(shared)
    return comps
