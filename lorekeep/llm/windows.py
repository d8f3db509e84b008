"""Repeated windows of words around anchors, found among sorted neighbours.

A row is a place in a text (doc_id, tag, pos) with an anchor, the words right of it and the words
left of it, nearest first, as 32-bit hashes.  Window b of a row is its b nearest words on the left and ``need`` - b
on the right.  Rows are range-sorted by (anchor, right words), so the places that share the right part of a
window are a run of neighbours whose common prefixes are long enough; within such a run the left parts are
compared by extending left, and each run of places that agree on both sides keeps its smallest place and reports the others.
Of places with equal words on both sides the smallest alone is compared.

Runs are decided in chunks of ``CHUNK`` sorted rows, which report what they find as spans, not as windows: windows of a text that overlap or touch are one.
A run that touches a chunk's border may go on beyond it: for
those alone the chunk's smallest place of each window stays open.  A place with open windows is one row, whatever their number; these are
sorted once more, by (anchor, left words), where windows that only one place has fall out.  The rest, with those whose runs touch a border again, go
to a table by a 64-bit hash of the window's
words, where the smallest place over all chunks is found.  So no task holds a run, however long it is, and no row is made for a window that occurs once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import _BASE, U64, _powers, mix
from .tables import discard, materialise

CHUNK = 1 << 15
ROWS = "anchor bigint, right binary, left binary, doc_id bigint, tag int, pos int, near int, far int"
_PLACE = [("anchor", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("pos", pa.int32())]
#: A span that occurs before, or (from ``anchor`` on) a place with its open windows, a bit for each.
_FOUND = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("first_doc_id", pa.int64()), *_PLACE, ("windows", pa.int64())])
_SHARED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("low", pa.int32())])
_STEP = U64(0x9E3779B97F4A7C15)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal width as binary values."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def around(h: np.ndarray, at: np.ndarray, right: int, left: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``right`` words from ``skip`` words after each place and the ``left`` words before it, nearest first; 0 beyond the text."""
    padded = np.concatenate([np.zeros(left, dtype=">u4"), (h >> U64(32)).astype(">u4"), np.zeros(right + skip, dtype=">u4")])
    return padded[at[:, None] + (left + skip) + np.arange(right)], padded[at[:, None] + left - 1 - np.arange(left)]


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each row."""
    out = np.zeros((len(words), words.shape[1] + 1), dtype=U64)
    np.cumsum(mix(words.astype(U64) + U64(1)) * _powers(_BASE, words.shape[1]), axis=1, out=out[:, 1:])
    return out


def common(right: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Words that each row and the one before have in common at the beginning; -1 where the anchors differ."""
    other = right[1:] != right[:-1]
    shared = np.where(other.any(axis=1), other.argmax(axis=1), right.shape[1])
    return np.concatenate([[-1], np.where(anchor[1:] == anchor[:-1], shared, -1)])


def _keys(anchor: np.ndarray, b: np.ndarray | int, to_left: np.ndarray, to_right: np.ndarray) -> np.ndarray:
    """Hashes of windows: their anchor, the number of words on the left, and the hashes of the words on both sides."""
    return mix(mix(mix(anchor.view(U64)) + np.asarray(b).astype(U64)) + to_right) ^ mix(to_left + _STEP)


def decide(
    anchor: np.ndarray, right: np.ndarray, left: np.ndarray, place: np.ndarray, near: np.ndarray, far: np.ndarray, need: int, only: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each sorted row and window (of those in ``only``): whether a smaller place has it, the row of the smallest, whether its run touches a border, and the windows' hashes."""
    n, most = len(right), left.shape[1]
    shared = common(right, anchor)
    order = np.lexsort(place.T[::-1])
    rank = np.zeros(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (place[order][1:] != place[order][:-1]).any(axis=1)]))
    holder = np.zeros(n, dtype=np.int64)
    holder[rank] = np.arange(n)
    to_left, to_right = _prefixes(left), _prefixes(right)
    later, first, edge = np.zeros((n, most + 1), dtype=bool), np.zeros((n, most + 1), dtype=np.int64), np.zeros((n, most + 1), dtype=bool)
    keys = np.zeros((n, most + 1), dtype=U64)
    for b in range(max(0, need - right.shape[1]), min(need, most) + 1):
        has = (near <= b) & (b <= far)
        rows = np.flatnonzero(has if only is None else has & only[:, b])
        if not len(rows):
            continue
        run = np.cumsum(shared < need - b)
        agree = mix(to_left[rows, b] + run[rows].astype(U64) * _STEP)
        by = np.argsort(agree)
        rows, agree = rows[by], agree[by]
        start = np.flatnonzero(np.concatenate([[True], agree[1:] != agree[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank[rows], start), np.diff(np.append(start, len(rows))))
        later[rows, b] = rank[rows] != least
        first[rows, b] = holder[least]
        edge[rows, b] = (run[rows] == 1) | (run[rows] == run[-1])
        keys[rows, b] = _keys(anchor[rows], b, to_left[rows, b], to_right[rows, need - b])
    return later, first, edge, keys


def _words(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values as rows of ``width`` words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").reshape(-1, width).astype(np.uint32)


def _alike(anchor: np.ndarray, right: np.ndarray, left: np.ndarray, place: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest places of sorted rows that are equal but for their place (ascending), and for each row which of those is its own."""
    run = np.cumsum(common(right, anchor) < right.shape[1]).astype(U64)
    h = mix(mix(_prefixes(left)[:, -1] + run * _STEP) + (near.astype(U64) << U64(32)) + far.astype(U64))
    order = np.lexsort((*place.T[::-1], h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    least = order[new]
    rows = np.sort(least)
    own = np.zeros(len(h), dtype=np.int64)
    own[order] = np.searchsorted(rows, least)[np.cumsum(new) - 1]
    return rows, own


def _joined(doc: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, known: np.ndarray, key: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows from low to high of a text that overlap or touch as one: the rows that start first (as ``merged`` chooses them), and the last starts."""
    if not len(doc):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort((key, ~known, first, low, tag, doc))
    doc, tag, low, high = doc[order], tag[order], low[order].astype(np.int64), high[order].astype(np.int64)
    text = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) << 33
    reach = np.maximum.accumulate(high + text)
    new = np.flatnonzero(np.concatenate([[True], (low + text)[1:] > reach[:-1] + need]))
    return order[new], np.maximum.reduceat(high, new)


def _chunk(part: pa.Table, right: int, left: int, need: int) -> pa.RecordBatch:
    anchor, doc, tag, pos, near, far = (part.column(c).to_numpy() for c in ("anchor", "doc_id", "tag", "pos", "near", "far"))
    rights, lefts, place = _words(part.column("right"), right), _words(part.column("left"), left), np.stack([doc, tag, pos], axis=1).astype(np.int64)
    near, far = np.maximum(near, max(0, need - right)), np.minimum(far, min(need, left))
    rows, own = _alike(anchor, rights, lefts, place, near, far)
    later, first, edge, keys = decide(anchor[rows], rights[rows], lefts[rows], place[rows], near[rows], far[rows], need)
    # neighbouring windows of a row that occur before are one interval of starts; all windows of a row that is like a smaller one do
    step = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    unit, b0 = np.nonzero(step == 1)
    b1 = np.nonzero(step == -1)[1] - 1
    copies = np.flatnonzero((place != place[rows[own]]).any(axis=1) & (near <= far))
    at, unit = np.concatenate([rows[unit], copies]), np.concatenate([unit, own[copies]])
    b0, b1 = np.concatenate([b0, near[copies]]), np.concatenate([b1, far[copies]])
    low, high, known, key, firsts = pos[at] - b1, pos[at] - b0, ~edge[unit, b1], keys[unit, b1].view(np.int64), doc[rows[first[unit, b1]]]
    kept, high = _joined(doc[at], tag[at], low, high, firsts, known, key, need)
    # the smallest places of windows whose runs touch a border
    open_ = edge & ~later
    left_open = np.flatnonzero(open_.any(axis=1))
    bits = (open_[left_open].astype(np.int64) << np.arange(left + 1)).sum(axis=1)
    where, k, m = np.concatenate([at[kept], rows[left_open]]), len(kept), len(left_open)
    is_open = np.arange(k + m) >= k
    padded = lambda x, kind, mask: pa.array(np.concatenate([x, np.zeros(m, dtype=x.dtype)]), kind, mask=mask)
    place_of = {c: part.column(c).combine_chunks().take(pa.array(np.where(is_open, where, -1), pa.int64(), mask=~is_open)) for c in ("anchor", "right", "left", "pos")}
    columns = {
        "key": padded(key[kept], pa.int64(), np.concatenate([known[kept], is_open[k:]])), "low": padded(low[kept], pa.int32(), is_open), "high": padded(high, pa.int32(), is_open), "first_doc_id": padded(firsts[kept], pa.int64(), is_open),
        "doc_id": pa.array(doc[where]), "tag": pa.array(tag[where], pa.int32()), **place_of, "windows": pa.array(np.concatenate([np.zeros(k, dtype=np.int64), bits]), mask=~is_open),
    }
    return pa.RecordBatch.from_arrays([columns[c] for c in _FOUND.names], schema=_FOUND)


def _shared(part: pa.Table, right: int, left: int, need: int) -> pa.RecordBatch:
    """The open windows that several places have, or may have beyond the chunk; rows are sorted by (anchor, left words), so the sides change their roles."""
    anchor, doc, tag, pos, bits = (part.column(c).to_numpy() for c in ("anchor", "doc_id", "tag", "pos", "windows"))
    rights, lefts, place = _words(part.column("right"), right), _words(part.column("left"), left), np.stack([doc, tag, pos], axis=1).astype(np.int64)
    open_ = (bits[:, None] >> np.arange(left + 1)) & 1 == 1
    turned = np.zeros((len(doc), right + 1), dtype=bool)  # by words on the right
    b = np.arange(max(0, need - right), min(need, left) + 1)
    turned[:, need - b] = open_[:, b]
    none = np.zeros(len(doc), dtype=np.int64)
    later, first, edge, _ = decide(anchor, lefts, rights, place, none, none + right, need, turned)
    row, w = np.nonzero(later)
    several = later | edge
    several[first[row, w], w] = True
    row, w = np.nonzero(several)
    b = need - w
    key = _keys(anchor[row], b, _prefixes(lefts)[row, b], _prefixes(rights)[row, w]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[row]), pa.array(tag[row], pa.int32()), pa.array(pos[row] - b, pa.int32())], schema=_SHARED)


def _in_chunks(rows: DataFrame, order: list[str], fn: Callable[..., pa.RecordBatch], schema: str, *sides: int) -> DataFrame:
    """``fn`` of chunks of the range-sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, CHUNK - sum(b.num_rows for b in held))
                held.append(batch.slice(0, take))
                batch = batch.slice(take)
                if sum(b.num_rows for b in held) == CHUNK:
                    yield fn(pa.Table.from_batches(held), *sides)
                    held = []
        if held:
            yield fn(pa.Table.from_batches(held), *sides)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def repeated_windows(rows: DataFrame, right: int, left: int, need: int) -> tuple[DataFrame, DataFrame]:
    """Spans that occur before: the words from low to high + ``need`` of a document (doc_id, tag, low, high, first_doc_id, key), and the firsts of open runs (key, first).

    ``first_doc_id`` holds the window at ``low`` at a smaller (doc_id, tag, position), the smallest one where ``key`` is null or not in the
    second table; else that holds the smallest (``merged`` looks it up).  ``rows``: as ``ROWS``, with ``near`` <= b <= ``far`` for the
    windows of a row that count.
    """
    # written, as ranges are drawn from a first reading
    rows = materialise(rows.select(*(c.split()[0] for c in ROWS.split(", "))), "around")
    found = materialise(_in_chunks(rows, ["anchor", "right", "doc_id", "tag", "pos"], _chunk, "key bigint, low int, high int, first_doc_id bigint, anchor bigint, right binary, left binary, doc_id bigint, tag int, pos int, windows bigint", right, left, need), "found")
    discard(rows)
    places = found.where("windows is not null").select("anchor", "right", "left", "doc_id", "tag", "pos", "windows")
    shared = _in_chunks(places, ["anchor", "left", "doc_id", "tag", "pos"], _shared, "key bigint, doc_id bigint, tag int, low int", right, left, need)
    # a key has a row from each chunk at most
    by = Window.partitionBy("key").orderBy("doc_id", "tag", "low")
    open_ = materialise(shared.select("key", "doc_id", "tag", "low", F.first("doc_id").over(by).alias("first"), F.rank().over(by).alias("n")), "open")
    later = open_.where("n > 1").select("doc_id", "tag", "low", F.col("low").alias("high"), F.col("first").alias("first_doc_id"), F.lit(None).cast("bigint").alias("key"))
    out = materialise(found.where("windows is null").select(*later.columns).union(later), "windows")
    firsts = materialise(open_.where("n = 1").select("key", "first").distinct(), "firsts")
    discard(found, open_)
    return out, firsts


def merged(spans: DataFrame, firsts: DataFrame) -> DataFrame:
    """Spans (doc_id, tag, start, end, first_doc_id, key) of a document that overlap or touch as one, with the first of that which starts first."""
    by = Window.partitionBy("doc_id", "tag").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(by))
    out = marked.groupBy("doc_id", "tag", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "first_doc_id", "key")).alias("f"))
    out = materialise(out.select("doc_id", "tag", "start", "end", "f.first_doc_id", "f.key"), "merged")
    known = out.where("key is null").select("doc_id", "tag", "start", "end", "first_doc_id")
    return known.union(out.where("key is not null").join(firsts.hint("merge"), "key", "left").select("doc_id", "tag", "start", "end", F.least("first", "first_doc_id")))
