"""Suffix-array dedup with sparse suffix arrays.

Texts are sequences of words (lower-cased, between white space).  Only suffixes at
minimiser positions are retained: positions whose ``K``-word hash is smallest in
a window of ``WINDOW`` of them (the first of equals).  A passage of ``min_words``
(50) words is placed at the minimiser of its first ``K + WINDOW - 1`` = 47 words,
which is the same place in all its copies.  Suffixes whose first K words
occur once can't be repeated and go.  The rest are sorted by their next ``min_words`` words.
Neighbours that have enough words in common form runs, and within a run matches are extended
left of the minimiser by up to ``LEFT`` words: places that agree on a whole passage keep their smallest
(doc_id, tag, position), and all others are reported (``windows``).  Overlapping and adjoining passages of
one document join into spans.  So every passage of ``min_words`` words that occurs before is reported,
however many copies it has.

Words are compared by 32 bits of their hashes and, beyond a chunk of sorted rows, passages by 64 bits over all their
words, so chance matches don't occur in practice; spans are of whole words.

Defined results: null and empty texts, and texts below ``min_words`` words, have no spans; rows of null doc_id
take no part.  Rows equal in doc_id and text count as one document; unlike texts of one doc_id are documents of their own,
told apart by ``tag``, a hash of the text.  Ties: of equal passages in one document the first stays.  Very long texts are
read whole, about 4 MB (one text at least) at a time; a text without white space is one word.  An empty table gives an empty
table.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import U64, shingles, words
from .tables import arrow_map, discard, materialise, slices
from .windows import ROWS, around, binary, merged, repeated_windows

K, WINDOW = 8, 40
LEFT = WINDOW - 1
MIN_WORDS = 50


def minimisers(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, K-word hashes, and words from the last and the first passage of ``min_words`` words placed there to the position."""
    n = len(h) - min_words + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    s = shingles(h, K)
    w = np.lib.stride_tricks.sliding_window_view(s, WINDOW)[:n]
    at, first, many = np.unique(np.arange(n) + w.argmin(axis=1), return_index=True, return_counts=True)
    return at, s[at], at - first - many + 1, at - first


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), text of the rows that have a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash(text).alias("tag"), text.alias("text")).where("doc_id is not null")


def _seeds(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            made = [minimisers(words(text.as_py() or "")[3], min_words) for text in part.column("text")]
            at, key, near, far = (np.concatenate(c) for c in zip(*made, strict=True))
            row = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
            yield {"key": key.view(np.int64), "doc_id": part.column("doc_id").take(row), "tag": part.column("tag").take(row), "pos": at.astype(np.int32), "near": near.astype(np.int32), "far": far.astype(np.int32)}

    return arrow_map(docs, run, "key bigint, doc_id bigint, tag int, pos int, near int, far int")


def _suffixes(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """The retained suffixes with the words on both sides of their minimisers."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text", 1 << 20):
            rights, lefts, rows, places = [], [], [], []
            for row, (text, found) in enumerate(zip(part.column("text"), part.column("places").to_pylist(), strict=True)):
                at = np.array([(p["pos"], p["near"], p["far"]) for p in found], dtype=np.int32)
                right, left = around(words(text.as_py() or "")[3], at[:, 0], min_words, LEFT)
                rights.append(right)
                lefts.append(left)
                places.append(at)
                rows += [row] * len(at)
            at, row = np.concatenate(places), pa.array(rows, pa.int64())
            yield {"anchor": np.zeros(len(at), dtype=np.int64), "right": binary(np.concatenate(rights)), "left": binary(np.concatenate(lefts)), "doc_id": part.column("doc_id").take(row), "tag": part.column("tag").take(row), "pos": at[:, 0], "near": at[:, 1], "far": at[:, 2]}

    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("pos", "near", "far")).alias("places"))
    # the same plan at every size
    return arrow_map(docs.join(lists.hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "places"), run, ROWS)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag (of the text), start_word, end_word, n_words, first_doc_id (of the span's first passage): spans of words that occur before."""
    if min_words < K + WINDOW - 1:
        raise ValueError(f"passages of {min_words} words may hold no minimiser")
    docs = tagged(docs)
    seeds = materialise(_seeds(docs, min_words), "seeds")
    # written, so that the join's sides are plain shuffles and a hot key's rows are dealt anew
    often = materialise(seeds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "often")
    wanted = materialise(seeds.join(often.hint("merge"), "key").drop("key"), "wanted")
    discard(seeds, often)
    found, firsts = repeated_windows(_suffixes(docs, wanted, min_words), min_words, LEFT, min_words)
    discard(wanted)
    out = merged(found.select("doc_id", "tag", F.col("low").alias("start"), (F.col("high") + min_words).alias("end"), "first_doc_id", "key"), firsts)
    discard(found)
    return out.select("doc_id", "tag", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated span of 50 words or more of the whole table."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
