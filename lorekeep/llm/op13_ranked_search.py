"""Ranked lexical search by hybrid TAAT-DAAT over document shards.

Terms are the maximal runs of letters, digits and characters beyond ASCII, only A-Z lower-cased.  A block of
items with at most about ``BLOCK_TERMS`` terms is searched at once; its distinct terms go to all tasks.

1. One pass over the texts writes shards: the ids and lengths of up to about ``SHARD_BYTES`` of
   whole texts, and for each query term in them its postings (document, occurrences) in document order.
2. N, L and df are summed over the shards.
3. Each task searches its shards for each item.  A term's weighted contributions and their maximum are known for the shard.
   The shortest lists, as long as their postings together are at most as many as the longest list's, are taken term
   at a time: their summed accumulators form one list in document order, whose largest sum is its
   bound.  From there on it is an iterator like any other.  Lists are ordered by bound; those whose bounds together stay
   below the tenth best score so far can't bring a document in alone and are only looked up.  The other lists
   propose documents in document order, a run of documents at a time; each list not proposing is
   sought by binary search at those alone, skipping all others, and a document is given up as soon as its
   score and the bounds left stay below the tenth best.
4. The tasks' ten best of each item meet by item, ranked before the shuffle and after.

Nothing is dropped that could be among the best: a document is given up only if its score is provably below
the tenth best, and equal scores stay in play.  Terms are compared by 64-bit hashes.

Defined results: a null or empty text, and one without terms, is found by nothing and counts in neither N nor L.  Each row is a
document of its own, repeated rows and rows of one doc_id as well: equal scores go by ascending doc_id
(null last), equal doc_ids get successive ranks.  Items equal in item_id and text are one item; unlike texts of one item_id are ranked each.
Items without terms, or whose terms no document holds, have no rows.  Very long texts are read whole, one at least to a shard.
Empty tables give an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import IS_NO_LETTER, words
from .tables import arrow_map, discard, materialise

TOP, B, K1 = 10, 75, 8
SHARD_BYTES, BLOCK_TERMS, RUN = 32 << 20, 200_000, 4096
SHARD = "ids array<bigint>, lengths binary, terms binary, starts binary, docs binary, counts binary"


def terms_of(text: str) -> np.ndarray:
    """Hashes of the terms of a text, in order, with repeats."""
    return words(text, gaps=IS_NO_LETTER)[3]


class _Shard:
    """Gathers documents until they are written as one row."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.wanted, self.size = wanted, 0
        self.ids: list = []
        self.lengths: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, text: str) -> None:
        h = terms_of(text)
        self.size += len(text)
        if not len(h):
            return
        at = np.minimum(np.searchsorted(self.wanted, h), len(self.wanted) - 1)
        term, n = np.unique(at[self.wanted[at] == h], return_counts=True)
        self.found.append((np.full(len(term), len(self.ids)), term, n))
        self.ids.append(doc_id)
        self.lengths.append(len(h))

    def row(self) -> dict:
        doc, term, n = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, dtype=np.int64),) * 3
        order = np.argsort(term, kind="stable")  # documents stay in order
        terms, starts = np.unique(term[order], return_index=True)
        raw = {"lengths": np.array(self.lengths), "terms": terms, "starts": np.append(starts, len(term)), "docs": doc[order], "counts": n[order]}
        return {"ids": [self.ids]} | {k: [v.astype("<i8" if k == "lengths" else "<i4").tobytes()] for k, v in raw.items()}


def _shards(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # at most a block's terms
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(held.value)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pydict(shard.row(), schema=schema)
                    shard = _Shard(held.value)
        if shard.ids:
            yield pa.RecordBatch.from_pydict(shard.row(), schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, SHARD)


def _statistics(shards: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term, summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 2, dtype=np.int64)
        for batch in batches:
            for lengths, terms, starts in zip(*(batch.column(c).to_pylist() for c in ("lengths", "terms", "starts")), strict=True):
                n = np.frombuffer(lengths, dtype="<i8")
                df[np.frombuffer(terms, dtype="<i4")] += np.diff(np.frombuffer(starts, dtype="<i4"))
                df[-2:] += [len(n), n.sum()]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": at, "n": df[at]})

    total = np.zeros(n_terms + 2, dtype=np.int64)
    for r in shards.select("lengths", "terms", "starts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a block's terms
        total[r.term] = r.n
    return int(total[-2]), int(total[-1]), total[:-2]


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + K1 m) with m = 100 - B + (B n N) div L, for postings of ``counts`` in documents of ``lengths``."""
    if len(lengths) and int(lengths.max()) * B * n_docs >= 1 << 63:
        lengths = lengths.astype(object)
    m = (100 - B + B * lengths * n_docs // n_all).astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + K1 * m)


class Best:
    """The best (score, doc_id) of an item so far; equal scores by ascending doc_id, null last."""

    def __init__(self, top: int = TOP) -> None:
        self.top, self.rows, self.least = top, [], 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.rows += zip((-scores).tolist(), null.tolist(), ids.tolist(), strict=True)
        self.rows = sorted(self.rows)[: self.top]
        if len(self.rows) == self.top:
            self.least = -self.rows[-1][0]


class ShardSearch:
    """A shard's postings, with their impacts."""

    def __init__(self, row: dict, n_docs: int, n_all: int) -> None:
        self.null = np.array([i is None for i in row["ids"]])
        self.ids = np.array([i or 0 for i in row["ids"]], dtype=np.int64)
        lengths = np.frombuffer(row["lengths"], dtype="<i8")
        self.terms, self.starts, self.docs, counts = (np.frombuffer(row[c], dtype="<i4") for c in ("terms", "starts", "docs", "counts"))
        self.impact = impacts(counts.astype(np.int64), lengths[self.docs], n_docs, n_all)
        self.most = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.terms) else self.impact
        self.buffer = np.zeros(len(self.ids), dtype=np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer all documents that may be among the best; ``weights`` of distinct ``terms``, repeats counted."""
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = (self.terms[at] == terms) & (weights > 0)
        at, weights = at[here], weights[here]
        if not len(at):
            return
        bounds = weights * self.most[at]
        if int(bounds.sum()) < best.least:
            return
        size = self.starts[at + 1] - self.starts[at]
        order = np.argsort(size, kind="stable")
        # short lists: together no more postings than the longest list
        n_short = int(np.searchsorted(np.cumsum(size[order]), size.max(), side="right"))
        lists = []  # (bound, documents, contributions or None, impacts, weight)
        short = order[:n_short]
        if len(short):
            lists.append(self._accumulated(at[short], weights[short]))
        for i in order[n_short:]:
            span = slice(self.starts[at[i]], self.starts[at[i] + 1])
            lists.append((int(bounds[i]), self.docs[span], self.impact[span], int(weights[i])))
        lists.sort(key=lambda x: x[0])
        self._by_document(lists, best)

    def _accumulated(self, at: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, int]:
        """The sums of the short lists, term at a time, as one list with its largest sum as bound."""
        for i, w in zip(at, weights, strict=True):
            span = slice(self.starts[i], self.starts[i + 1])
            self.buffer[self.docs[span]] += int(w) * self.impact[span]
        docs = np.unique(np.concatenate([self.docs[self.starts[i] : self.starts[i + 1]] for i in at]))
        sums = self.buffer[docs]
        self.buffer[docs] = 0
        return int(sums.max()), docs, sums, 1

    def _by_document(self, lists: list[tuple[int, np.ndarray, np.ndarray, int]], best: Best) -> None:
        upto = np.cumsum([0] + [x[0] for x in lists]).tolist()  # bounds of the lists before each
        begin, n = 0, len(self.ids)
        while begin < n:
            # the lists before ``first`` can't reach the least of the best together
            first = int(np.searchsorted(upto, best.least)) - 1
            if first >= len(lists):
                return
            # the run ends where the proposing lists have about RUN postings more
            leads = [(x, int(np.searchsorted(x[1], begin))) for x in lists[first:]]
            step = max(1, RUN // len(leads))
            end = min((int(x[1][a + step]) for x, a in leads if a + step < len(x[1])), default=n)
            end = max(end, begin + 1)
            spans = [(x, slice(a, int(np.searchsorted(x[1], end)))) for x, a in leads]
            docs = np.unique(np.concatenate([x[1][s] for x, s in spans]))
            if len(docs):
                for x, s in spans:
                    self.buffer[x[1][s]] += x[3] * x[2][s]
                scores = self.buffer[docs]
                self.buffer[docs] = 0
                for i in range(first - 1, -1, -1):  # lists that are only looked up, the largest bound first
                    stay = scores + upto[i + 1] >= best.least
                    docs, scores = docs[stay], scores[stay]
                    if not len(docs):
                        break
                    _, own, impact, weight = lists[i]
                    to = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                    scores = scores + np.where(own[to] == docs, weight * impact[to], 0)
                stay = np.flatnonzero(scores >= best.least)
                at = docs[stay]
                order = np.lexsort((self.ids[at], self.null[at], -scores[stay]))[: best.top]
                best.offer(scores[stay][order], self.ids[at[order]], self.null[at[order]])
            begin = end


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, uid (of the text), terms (hashes, with repeats), n of the items that have terms."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        terms = [terms_of(t.as_py()).view(np.int64) for t in batch.column("text")]
        yield {"item_id": batch.column("item_id"), "uid": batch.column("uid"), "terms": terms, "n": [len(t) for t in terms]}

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    rows = rows.withColumn("uid", F.xxhash64("text"))
    return arrow_map(rows, run, "item_id bigint, uid bigint, terms array<bigint>, n bigint").where("n > 0")


def _search_block(docs: DataFrame, items: list) -> DataFrame:
    """item_id, uid, doc_id, score: the best documents of each task for each item of a block, written."""
    sc = docs.sparkSession.sparkContext
    wanted = np.unique(np.concatenate([np.array(r.terms, dtype=np.int64).view(np.uint64) for r in items]))
    shards = materialise(_shards(docs, wanted), "shards")
    n_docs, n_all, df = _statistics(shards, len(wanted))
    weights = weights_of(df, n_docs)
    queries = []
    for r in items:
        at, repeats = np.unique(np.searchsorted(wanted, np.array(r.terms, dtype=np.int64).view(np.uint64)), return_counts=True)
        queries.append((r.item_id, r.uid, at, weights[at] * repeats))
    held = sc.broadcast(queries)  # a block's items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in held.value]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = ShardSearch(batch.slice(i, 1).to_pylist()[0], n_docs, n_all)
                for (_, _, terms, own), b in zip(held.value, best, strict=True):
                    shard.search(terms, own, b)
        rows = [(item, uid, None if null else doc, -score) for (item, uid, _, _), b in zip(held.value, best, strict=True) for score, null, doc in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["item_id", "uid", "doc_id", "score"])

    out = materialise(shards.mapInArrow(run, "item_id bigint, uid bigint, doc_id bigint, score bigint"), "found")
    discard(shards)
    return out


def ranked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ``TOP`` best documents of each item."""
    items = materialise(_items(benchmark), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    found = None
    for i in range(blocks):
        # about BLOCK_TERMS terms
        block = items.where(F.pmod(F.xxhash64("item_id", "uid"), F.lit(blocks)) == i).collect()
        if block:
            own = _search_block(docs, block)
            found = own if found is None else found.union(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id bigint, uid bigint, doc_id bigint, score bigint")
    by = Window.partitionBy("item_id", "uid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""
WITH held AS (SELECT doc_id, row_number() OVER () AS d, text FROM documents WHERE text IS NOT NULL),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, {_TERMS} AS term FROM held) GROUP BY d, term),
lengths AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
m AS (SELECT d, 100 - {B} + (({B} * n * n_docs) // n_all) AS m FROM lengths, totals),
asked AS (SELECT item_id, text, term, count(*) AS q FROM (SELECT item_id, text, {_TERMS} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, text, term),
scored AS (SELECT item_id, asked.text, d, sum(q * w * ((1000000000 * tf) // (1000 * tf + {K1} * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN m USING (d) GROUP BY item_id, asked.text, d),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, scored.text ORDER BY score DESC, doc_id ASC NULLS LAST, d) AS rank FROM scored JOIN held USING (d) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {TOP}
"""
