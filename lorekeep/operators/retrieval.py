"""Ranked retrieval of records for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most query terms that one pass ships to all tasks.
MAX_TERMS = 200_000
#: Records whose hits are made at once.
SLICE = 200
_HITS = pa.schema([("id", pa.string()), ("term", pa.string()), *((c, pa.bool_()) for c in ("in_title", "exact_title", "in_tags", "in_story"))])


def term_hits(records: DataFrame, terms: list[str]) -> DataFrame:
    """id, term, in_title, exact_title, in_tags, in_story: containment of many terms in one pass over the records.

    An automaton of ``MAX_TERMS`` terms reads each text once; more terms go in several passes.
    """
    distinct = sorted({t for t in terms if t})
    if len(distinct) > MAX_TERMS:
        return reduce(DataFrame.union, [term_hits(records, distinct[i : i + MAX_TERMS]) for i in range(0, len(distinct), MAX_TERMS)])
    shared = records.sparkSession.sparkContext.broadcast(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for t in shared.value:
            a.add_word(t, t)
        if len(a):
            a.make_automaton()
        for batch in batches:
            # a few texts at a time, so that neither texts nor hits of a whole batch become objects
            for at in range(0, batch.num_rows, SLICE):
                ids, titles, tags, stories = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                out: list[list] = [[] for _ in _HITS]
                for i, *texts in zip(ids, titles, tags, stories, strict=True):
                    found = [{t for _, t in a.iter(x)} if x and len(a) else set() for x in texts]
                    for t in set().union(*found):
                        for column, value in zip(out, (i, t, t in found[0], t == texts[0], t in found[1], t in found[2]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _HITS, strict=True)], schema=_HITS)

    text = records.select("id", F.lower("title").alias("title"), F.lower(F.array_join("tags", " ")).alias("tags"), F.lower("story").alias("story"))
    return text.mapInArrow(run, "id string, term string, in_title boolean, exact_title boolean, in_tags boolean, in_story boolean")


def stale_penalty() -> Column:
    """What a record loses whose status says that others took its place."""
    return F.when(F.lower("status").isin("superseded", "archived", "obsolete"), 12).otherwise(0)


def relevance(hits: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, id, score for every record that any term of a query hits.

    ``queries``: query_id, query (lower-cased), terms (with the query itself).
    """
    wanted = queries.select("query_id", "query", F.explode("terms").alias("term")).distinct()
    full = F.col("term") == F.col("query")
    n = lambda c: F.count_if(F.col(c))
    score = hits.join(wanted, "term").groupBy("query_id", "id").agg(
        (
            F.max(F.when(full & F.col("exact_title"), 30).when(full & F.col("in_title"), 18).otherwise(0))
            + F.least(F.lit(24), 6 * n("in_title"))
            + F.least(F.lit(16), 4 * n("in_tags"))
            + F.max(F.when(full & F.col("in_story"), 4).otherwise(0))
            + F.least(F.lit(8), n("in_story"))
        ).alias("score")
    )
    return score.join(records.select("id", stale_penalty().alias("stale")), "id").select("query_id", "id", (F.col("score") - F.col("stale")).cast("bigint").alias("score"))


def top_k(scores: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: best scores first, then heat, then the newest, then the id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("used_count"), F.desc("ts"), "id")
    return scores.join(records.select("id", "used_count", "ts"), "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
