"""Substring dedup by Paragraph MinHash banding over content-defined paragraphs.

Passages run over line ends, so a paragraph is defined by content: its begin is
the smallest of ``WINDOW`` neighbouring hashes of ``BEGIN`` (8) words (the first of
equals), and it takes ``WORDS`` words from there.  A passage of ``min_words``
(50) words holds a whole paragraph in all its copies: the begin that its first
``WINDOW`` hashes choose lies in its first 30 words.

Method: linked paragraphs share 20 words at their ends or, where they repeat a 3-word sequence,
one of their smallest shingles (``sought_keys``).  A paragraph of which no such key occurs in another is linked with
none and goes; no pair is left out.  (Without ``whole`` those alone are compared whose begin occurs elsewhere; the queries never do that.)
The other paragraphs form classes of equal words.  Each class has minima of its
5-word shingle set under linear hashes in ``BANDS`` bands of ``ROWS``: two
sets of 17 shingles that differ in one (similarity 0.89, the least above 0.8) share no band
with a probability of 0.003.  These share a link key, which all linked pairs do, so no pair is left out.
Unlike classes that share a band key or a link key are confirmed by exact Jaccard similarity of their
full shingle sets, and components of the links are clusters.  The first occurrence of a
cluster (smallest doc_id, then position) stays and all others are repeated.
Touching repeated paragraphs of a document become one span.  Its outer paragraphs are compared with all others of their
clusters, not the first alone: passages of ``min_words`` words around a paragraph that agree on all words beside it
keep their smallest place, and the others extend the span (``windows``).  Spans of ``min_words`` words or more are the result.  So
every passage of ``min_words`` words that occurs before is found: it holds a whole paragraph, and either lies in a span or
runs over one of its ends.

Defined results: null and empty texts, and texts below ``min_words`` words,
have no paragraphs and stay as they are.  Ties: of occurrences in one document the first stays.
Rows with equal doc_id and text count as one document, rows of one doc_id with unlike texts as
two, told apart by a hash of the text.  Rows of null doc_id take no part and stay.  A document
that is cut whole keeps an empty text.  Very long texts are read whole, a batch of about 4 MB
of text (one text at least) at a time; a text without white space is one word.  An empty table
gives an empty table.  Other columns are not read, whatever their names, and ``without_repeats`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import _BASE, U64, mix, shingles, words
from .lsh import groups
from .op2_suffix_array_dedup import tagged
from .tables import arrow_map, discard, materialise, packed, slices
from .windows import ROWS as WINDOW_ROWS
from .windows import around, binary, merged, repeated_windows

WORDS, WINDOW, SHINGLE, BEGIN = 21, 30, 5, 8
BANDS, ROWS = 5, 3
MIN_WORDS = 50
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)
_B = mix(np.arange(101, BANDS * ROWS + 101, dtype=U64))
_POWERS = np.array([pow(_BASE, WORDS - 1 - i, 1 << 64) for i in range(WORDS)], dtype=U64)
#: A document, and a place in it.
DOC = ("doc_id", "tag")


def begins(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the paragraphs of a text's word hashes, and the hashes that chose them."""
    n = len(h) - min_words + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), h[:0]
    s = shingles(h, BEGIN)
    at = np.unique(np.arange(n) + np.lib.stride_tricks.sliding_window_view(s, WINDOW)[:n].argmin(axis=1))
    return at, s[at]


def ids_at(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences of the paragraphs that begin at ``at``."""
    return mix((h[at[:, None] + np.arange(WORDS)] * _POWERS).sum(axis=1, dtype=U64)).view(np.int64)


def sets_at(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The shingle hashes of the paragraphs that begin at ``at``, a row for each."""
    return s[at[:, None] + np.arange(WORDS - SHINGLE + 1)]


def band_keys(sets: np.ndarray) -> np.ndarray:
    """One key for each paragraph and band."""
    low = [(sets * a + b).min(axis=1) for a, b in zip(_A, _B, strict=True)]
    keys = [mix(mix(low[i] + U64(i)) + low[i + 1]) for i in range(0, BANDS * ROWS, ROWS)]
    return np.stack(keys, axis=1).view(np.int64)


def n_link_keys(percent: int) -> int:
    """How many smallest shingles of one set a linked pair must meet in, at most: all but the overlap that a link needs, and one more."""
    n = WORDS - SHINGLE + 1
    return n - -(-percent * n // 100) + 1


def end_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the first and of the last 20 words of the paragraphs at ``at``; a key of the one may meet one of the other."""
    return mix(np.stack([(h[at[:, None] + d + np.arange(WORDS - 1)] * _POWERS[1:]).sum(axis=1, dtype=U64) for d in (0, 1)], axis=1)) | U64(1)


def _repeating(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each paragraph repeats a 3-word sequence."""
    threes = np.sort(shingles(h, 3)[at[:, None] + np.arange(WORDS - 2)], axis=1)
    return (threes[:, 1:] == threes[:, :-1]).any(axis=1)


def link_keys(h: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the paragraphs at ``at``, of which two with a similarity of ``percent`` share one; 0 is no key.

    The overlap of linked sets is ``percent`` of each at least, so the smallest shingles of both, all but that many and one more, have one in common.
    From 80 percent a paragraph without a repeated 3-word sequence needs two keys alone.  A set linked with its set leaves out one of its 17 shingles at most and
    has one strange shingle, or two if it repeats one.  In a text the shingle after one of the paragraph is the next of the paragraph or strange, and no single strange one leads
    back to the paragraph, as the three words that both share would be repeated in it.  So strange ones stand at the ends, and the two share their first or last 20 words.
    """
    width, n = n_link_keys(percent), WORDS - SHINGLE + 1
    sets = np.sort(sets_at(shingles(h, SHINGLE), at), axis=1)
    sets[:, 1:][sets[:, 1:] == sets[:, :-1]] = ~U64(0)
    low = np.sort(sets, axis=1)[:, :width]
    low = np.where(low == ~U64(0), U64(0), mix(low + U64(1)) | U64(1))
    if percent >= 80:
        low[~_repeating(h, at)] = 0
    return np.concatenate([end_keys(h, at), low], axis=1).view(np.int64)


def sought_keys(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the paragraphs at ``at``: keys of which two with a similarity of ``percent`` share one, few enough for every paragraph.

    They are the link keys; from 80 percent only those with a repeated 3-word sequence need more than the two of their ends.
    """
    ends = end_keys(h, at)
    ends[ends[:, 0] == ends[:, 1], 1] = 0
    again = np.arange(len(at))
    if percent >= 80:
        again = again[_repeating(h, at)]
    low = link_keys(h, at[again], percent)[:, 2:] if len(again) else ends[:0]
    (row, column), (own, key) = np.nonzero(ends), np.nonzero(low)
    return np.concatenate([row, again[own]]), np.concatenate([ends[row, column].view(np.int64), low[own, key].view(np.int64)])


def _paragraphs(docs: DataFrame, min_words: int, percent: int, whole: bool) -> DataFrame:
    """key, doc_id, tag, pos, id (of the word sequence) of every paragraph: a row for each of its sought keys, or one with the hash of its begin."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            none = np.zeros(0, dtype=np.int64)
            pos, key, ids = [none], [none], [none]
            for text in part.column("text"):
                h = words(text.as_py() or "")[3]
                at, chosen = begins(h, min_words)
                row, keys = sought_keys(h, at, percent) if whole and len(at) else (np.arange(len(at)), chosen.view(np.int64))
                pos.append(at[row])
                key.append(keys)
                ids.append(ids_at(h, at)[row] if len(at) else none)
            row = pa.array(np.repeat(np.arange(part.num_rows), [len(p) for p in pos[1:]]))
            yield {"key": np.concatenate(key), "doc_id": part.column("doc_id").take(row), "tag": part.column("tag").take(row), "pos": np.concatenate(pos).astype(np.int32), "id": np.concatenate(ids)}

    return arrow_map(docs.select(*DOC, "text"), run, "key bigint, doc_id bigint, tag int, pos int, id bigint")


def _at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """text and ``places`` (ascending positions) of the documents that have some: the same plan at every size."""
    lists = places.groupBy(*DOC).agg(F.sort_array(F.collect_set("pos")).alias("places"))
    return docs.join(lists.hint("shuffle_hash"), [*DOC]).select(*DOC, "text", "places")


def _sets(docs: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """id, n, sig (the band keys and link keys), hashes (32 bits each): the full sets of classes, read at their first occurrence (``wanted``: doc_id, tag, pos)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            out: dict[str, list] = {"id": [], "n": [], "sig": [], "hashes": []}
            for text, places in zip(part.column("text"), part.column("places").to_pylist(), strict=True):
                h, at = words(text.as_py() or "")[3], np.array(places)
                sets = sets_at(shingles(h, SHINGLE), at)
                out["id"] += ids_at(h, at).tolist()
                out["sig"] += [k.tobytes() for k in np.concatenate([band_keys(sets), link_keys(h, at, percent)], axis=1)]
                low = np.sort((sets >> U64(32)).astype(np.uint32), axis=1)
                again = (low[:, 1:] == low[:, :-1]).any(axis=1)
                full = [np.unique(s) if x else s for s, x in zip(low, again, strict=True)]
                out["n"] += [len(s) for s in full]
                out["hashes"] += [s.tobytes() for s in full]
            yield out

    return arrow_map(_at_places(docs, wanted), run, "id bigint, n bigint, sig binary, hashes binary").dropDuplicates(["id"])


def _contexts(docs: DataFrame, wanted: DataFrame, beside: int) -> DataFrame:
    """The ``beside`` words on both sides of the paragraphs at ``wanted`` places (doc_id, tag, pos, anchor)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text", 1 << 20):
            rights, lefts, rows, places = [], [], [], []
            for row, (text, found) in enumerate(zip(part.column("text"), part.column("places").to_pylist(), strict=True)):
                h = words(text.as_py() or "")[3]
                at = np.array([(p["pos"], p["anchor"]) for p in found], dtype=np.int64)
                right, left = around(h, at[:, 0], beside, beside, WORDS)
                rights.append(right)
                lefts.append(left)
                # windows that lie in the text
                places.append(np.column_stack([at, np.maximum(0, beside - (len(h) - at[:, 0] - WORDS)), np.minimum(beside, at[:, 0])]))
                rows += [row] * len(at)
            at, row = np.concatenate(places), pa.array(rows, pa.int64())
            small = at.astype(np.int32)
            yield {"anchor": at[:, 1], "right": binary(np.concatenate(rights)), "left": binary(np.concatenate(lefts)), "doc_id": part.column("doc_id").take(row), "tag": part.column("tag").take(row), "pos": small[:, 0], "near": small[:, 2], "far": small[:, 3]}

    lists = wanted.groupBy(*DOC).agg(F.collect_set(F.struct("pos", "anchor")).alias("places"))
    return arrow_map(docs.join(lists.hint("shuffle_hash"), [*DOC]).select(*DOC, "text", "places"), run, WINDOW_ROWS)


def _members(docs: DataFrame, min_words: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, tag, pos, anchor (of the cluster), first_doc_id, later (than the cluster's first occurrence): every paragraph of a cluster of several."""
    found = materialise(_paragraphs(docs, min_words, percent, whole), "paragraphs")
    # tables that are joined are written, so that both sides are plain shuffles, of which Spark splits a hot key's partition
    often = materialise(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "often")
    occurrences = found.join(often.hint("merge"), "key").select(*DOC, "pos", "id")
    occurrences = materialise(occurrences.distinct() if whole else occurrences, "occurrences")
    discard(found, often)
    place = F.struct(*DOC, "pos")
    classes = materialise(occurrences.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")), "classes")
    sets = materialise(_sets(docs, classes.select("first.*"), percent), "sets")
    items = sets.select("id", "n", "sig")
    keys_of = lambda sig: np.ascontiguousarray(sig).view(np.int64).reshape(len(sig), -1)

    def keys(batch: pa.RecordBatch) -> Iterator[dict]:
        flat = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.int64)
        width = BANDS + 2 + n_link_keys(percent)
        made = pd.DataFrame({"key": flat, "id": np.repeat(batch.column("id").to_numpy(), width), "n": np.repeat(batch.column("n").to_numpy(), width)})
        # a class may have one key twice: its first and last words, of one word repeated
        made = made[made.key != 0].drop_duplicates(["id", "key"])
        yield {c: made[c].to_numpy() for c in made.columns}

    postings = arrow_map(items, keys, "key bigint, id bigint, n bigint")
    links = groups(items, postings, None, keys_of, lambda ids: sets.select("id", "hashes").join(ids.hint("merge"), "id", "left_semi"), percent, width=32)

    clusters = classes.join(links.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", "first", "c", F.coalesce("component", "id").alias("cluster"))
    heads = materialise(clusters.groupBy("cluster").agg(F.min("first").alias("head"), F.sum("c").alias("c")).where("c > 1").select("cluster", "head"), "clusters")
    of_class = materialise(clusters.select("id", "cluster").join(heads.hint("merge"), "cluster").select("id", "head"), "heads")
    # the clusters of one document's places are neighbours, so that windows that touch are met together
    anchor = F.shiftright(F.xxhash64("head.doc_id", "head.tag"), 1) + F.col("head.pos")
    out = occurrences.join(of_class.hint("merge"), "id").select(*DOC, "pos", anchor.alias("anchor"), F.col("head.doc_id").alias("first_doc_id"), (place != F.col("head")).alias("later"))
    out = materialise(out.distinct(), "members")
    discard(occurrences, classes, sets, heads, of_class)
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 80, whole: bool = False) -> DataFrame:
    """A row for each span to remove: doc_id, tag (of the text), start_word, end_word, n_words, first_doc_id.

    With ``whole``, as in the queries, every paragraph is compared with all that it may be linked with; without it, those alone whose begin occurs elsewhere.
    """
    if min_words < WORDS + WINDOW - 1:
        raise ValueError(f"passages of {min_words} words may hold no whole paragraph")
    docs, beside = tagged(docs), min_words - WORDS
    members = _members(docs, min_words, percent, whole)
    # runs of touching paragraphs, and the clusters of their first and last
    by = Window.partitionBy(*DOC).orderBy("pos")
    later = members.where("later").withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(by) > WORDS, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    runs = later.groupBy(*DOC, "run").agg(F.min(F.struct("pos", "first_doc_id", "anchor")).alias("a"), F.max(F.struct("pos", "anchor")).alias("z"))
    runs = materialise(runs.select(*DOC, F.col("a.pos").alias("start"), (F.col("z.pos") + WORDS).alias("end"), "a.first_doc_id", F.array("a.anchor", "z.anchor").alias("outer")), "runs")
    outer = materialise(runs.select(F.explode("outer").alias("anchor")).distinct(), "outer")
    around_them = materialise(members.join(outer.hint("merge"), "anchor", "left_semi").select(*DOC, "pos", "anchor"), "compared")
    found, firsts = repeated_windows(_contexts(docs, around_them, beside), beside, beside, beside)
    discard(members, outer, around_them)
    spans = runs.select(*DOC, "start", "end", "first_doc_id", F.lit(None).cast("bigint").alias("key"))
    spans = spans.union(found.select(*DOC, F.col("low").alias("start"), (F.col("high") + min_words).alias("end"), "first_doc_id", "key"))
    out = merged(spans, firsts).where(F.col("end") - F.col("start") >= min_words)
    discard(runs, found)
    return out.select(*DOC, F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ascending spans.  Of the two gaps around a span one with a line feed stays, else the first; at an end of the text none."""
    raw = text.encode("utf-8", "surrogatepass")
    _, starts, ends, _ = words(text, lower=False)
    out, kept = [], 0
    for a, z in spans:
        before = int(ends[a - 1]) if a else 0
        after = int(starts[z]) if z < len(starts) else len(raw)
        gap, following = raw[before : starts[a]], raw[ends[z - 1] : after]
        out.append(raw[kept:before])
        if a and z < len(starts):
            out.append(gap if b"\n" in gap or b"\n" not in following else following)
        kept = after
    return b"".join([*out, raw[kept:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated spans cut from ``text``; all rows and columns stay."""
    spans = repeated_spans(docs, **options).groupBy(*DOC).agg(F.flatten(F.sort_array(F.collect_list(F.array("start_word", "end_word")))).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__cut_id"), F.col("tag").alias("__cut_tag"), "__spans")

    @F.pandas_udf("string")
    def cut_all(text: pd.Series, found: pd.Series) -> pd.Series:
        return text.combine(found, lambda t, x: t if x is None else cut(t, list(zip(x[::2], x[1::2], strict=True))))

    row = F.col("row")
    at = (row["doc_id"].cast("bigint") == F.col("__cut_id")) & (F.hash(row["text"].cast("string")) == F.col("__cut_tag"))
    out = packed(docs).join(spans.hint("shuffle_hash"), at, "left").withColumn("__text", cut_all(row["text"].cast("string"), F.col("__spans")))
    return out.select(*(F.col("__text").alias(c) if c == "text" else row[c].alias(c) for c in docs.columns))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated span of the whole table, with the document where its beginning stays."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=True)
