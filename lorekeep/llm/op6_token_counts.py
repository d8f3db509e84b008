"""Token counts by a count-only Viterbi over a unigram vocabulary.

Every match of a vocabulary piece is enumerated by an Aho-Corasick automaton with
failure and output links (``lattice.matches``), and dynamic programming carries the best score
and its piece count; no segmentation is stored.  Ties follow the tokenizer:
a node takes a new path only if it is strictly better.  Scores are summed in
double precision within a unit (a word with its leading spaces, or a line
feed), where the tokenizer's single precision is exact too.

Defined results: a null or empty text has 0 pieces and score 0.  A character
without a piece counts its UTF-8 bytes (byte fallback).  Repeated rows have equal counts;
a null doc_id is counted as any other.  Texts are read whole, about 1 MB (one text at least) at a
time; a long text without spaces is one unit and takes a numpy step for each of its characters.
An empty table gives an empty table.  Other columns are not read, whatever their names.
A vocabulary whose pieces run over word or line ends, or that changes texts first, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import Vocabulary, best_counts, build, distinct, units
from .tables import arrow_map, slices

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


class Counter:
    """Counts texts; remembers the units it has met, up to a bound, as sorted arrays."""

    def __init__(self, vocab: Vocabulary, bound: int = 400_000) -> None:
        self.vocab, self.bound = vocab, bound
        self.keys, self.score, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text."""
        b, starts, ends, owner = units(texts)
        if not len(starts):
            return np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        keys, first, which = distinct(b, starts, ends)
        score, count = np.zeros(len(keys)), np.zeros(len(keys), dtype=np.int64)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            score[known], count[known] = self.score[at[known]], self.count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            score[new], count[new] = best_counts(build(self.vocab, b, starts[first[new]], ends[first[new]]))
            if len(self.keys) + len(new) > self.bound:
                self.keys, self.score, self.count = keys, score, count
            else:
                at = np.searchsorted(self.keys, keys[new])
                self.keys, self.score, self.count = (np.insert(old, at, x[new]) for old, x in ((self.keys, keys), (self.score, score), (self.count, count)))
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[which])])[owner])
        return total(count), total(score)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, score for each row."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))
    counters: list[Counter] = []  # one for each task

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        held = counters[0] if counters else counters.append(Counter(vocab.value)) or counters[0]
        for part in slices(batch, "text", 1 << 20):
            n, score = held(part.column("text").to_pylist())
            yield {"doc_id": part.column("doc_id"), "n_tokens": n, "score": score}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "doc_id bigint, n_tokens bigint, score double")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
