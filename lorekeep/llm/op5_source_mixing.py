"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block`` documents, in the order of a hash
of doc_id.  Target weights are whole shares of ``period`` slots.  Block i of a
source of share s is released at slot floor(i * period / s) and due by slot
ceil((i + 1) * period / s); the released block of the earliest deadline is next
(ties: the smaller share of slack, then the source).  As the shares add up to
the period, every deadline is met, so at any slot each source has had its
weight's part of the slots within less than one block.  The schedule repeats
after one period, so that only one period's slots are computed (a table of
``period`` rows); the slot of any block follows from it by arithmetic.

Every document gets a place and none is dropped: where a source has no more
blocks its slots pass empty, and the others go on in their shares.  ``in_mix``
tells whether the slot lies before the first slot that passed empty.

Default weights: ``count ** alpha`` of each source (alpha 0.5 lifts small sources),
rounded to shares of at least one slot by largest remainders.

Defined results: a null source is a source of its own.  Null, empty and very long
texts count as one document each (only a hash of the text is carried).  Ties: documents of equal doc_id stand side
by side, ordered by the hash of their text, and those of null doc_id by the hash of their text among all; repeated rows each get a place of their own.  More sources
than a quarter of ``period`` lengthen the period; more than ``MAX_SOURCES`` is an error.  An
empty table gives an empty table.  Other columns are not read; ``mixed`` returns
them as they are, whatever their names.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .tables import packed

PERIOD, BLOCK, ALPHA = 1000, 64, 0.5
#: Sources are names of streams; their weights and one period's slots are held by the driver.
MAX_SOURCES = 100_000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period: at least one, largest remainders, adding up to the period."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit into {period} slots")
    if not weights:
        return {}
    total = sum(weights.values())
    exact = {k: (period - len(weights)) * (w / total if total else 1 / len(weights)) for k, w in weights.items()}
    out = {k: 1 + math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def schedule(share: dict[str, int], period: int = PERIOD) -> list[tuple[str, int, int]]:
    """(source, number of its block in the period, slot): earliest deadline first among released blocks."""
    waiting = sorted((i * period // s, k, i) for k, s in share.items() for i in range(s))
    ready: list[tuple[int, int, str, int]] = []
    out, at = [], 0
    for slot in range(period if share else 0):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, k, i = waiting[at]
            due = -(-(i + 1) * period // share[k])
            heapq.heappush(ready, (due, due - release, k, i))
            at += 1
        due, _, k, i = heapq.heappop(ready)
        if due <= slot:
            raise RuntimeError("a block missed its deadline")
        out.append((k, i, slot))
    return out


def _with_rank(docs: DataFrame, sized: DataFrame, rows: int) -> DataFrame:
    """``docs`` with ``__rank`` (from 0) of each document in its source ``__source``, by hash of doc_id (of the text, where it is null).

    Sources are cut into ranges of the hash of about ``rows`` documents, so no
    window holds a whole source; ranges' counts give where each range begins.
    ``sized`` has ``__n`` of each source, as many rows as there are sources.
    """
    h = F.when(F.col("doc_id").isNull(), F.col("__text_hash")).otherwise(F.xxhash64(F.col("doc_id")))
    # the hash as a fraction of its range, cut into as many ranges as the source needs
    part = F.floor((h.cast("double") / 2.0**64 + 0.5) * F.ceil(F.col("__n") / rows)).cast("long")
    dealt = docs.join(F.broadcast(sized), "__source").withColumn("__part", part).withColumn("__h", h).drop("__n")
    order = W.Window.partitionBy("__source").orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    begins = dealt.groupBy("__source", "__part").agg(F.count(F.lit(1)).alias("__c")).select("__source", "__part", F.coalesce(F.sum("__c").over(order), F.lit(0)).alias("__begin"))
    inside = W.Window.partitionBy("__source", "__part").orderBy("__h", "doc_id", "__text_hash")
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1)
    return ranked.join(begins, ["__source", "__part"]).withColumn("__rank", F.col("__begin") + F.col("__r")).drop("__part", "__h", "__begin", "__r")


def mix_order(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block: int = BLOCK, alpha: float = ALPHA, range_rows: int = 1000) -> DataFrame:
    """doc_id, source, text_hash, block, slot, place, in_mix for each row: the mix reads by (slot, place)."""
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source")))
    narrow = docs.select("doc_id", key.alias("__source"), F.xxhash64("text").alias("__text_hash"))
    counts = {r[0]: r[1] for r in narrow.groupBy("__source").count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: the schedule is computed on the driver")
    period = max(period, 4 * len(counts))  # many sources: a longer period, so that each gets slots
    share = shares({k: n**alpha for k, n in counts.items()} if weights is None else {k: weights.get(k[1:] if k != "-" else None, 0.0) for k in counts}, period)
    # the first slot that passes empty: the earliest slot that a source would need after its last block
    plan = schedule(share, period)
    slot_of = {(k, i): slot for k, i, slot in plan}
    empty = min((b // share[k] * period + slot_of[k, b % share[k]] for k, n in counts.items() for b in [-(-n // block)]), default=0)
    table = spark.createDataFrame([(k, i, slot, share[k]) for k, i, slot in plan], T.StructType.fromDDL("__source string, __i int, __slot int, __share int"))
    per_source = F.broadcast(table.select("__source", "__share").distinct())
    sized = spark.createDataFrame(list(counts.items()), "__source string, __n long")
    ranked = _with_rank(narrow, sized, range_rows).join(per_source, "__source").withColumn("block", F.floor(F.col("__rank") / block).cast("long"))
    ranked = ranked.withColumn("__i", (F.col("block") % F.col("__share")).cast("int"))
    placed = ranked.join(F.broadcast(table.drop("__share")), ["__source", "__i"])
    slot = F.floor(F.col("block") / F.col("__share")) * period + F.col("__slot")
    return placed.select("doc_id", F.when(F.col("__source") != "-", F.substring("__source", 2, 1 << 30)).alias("source"), F.col("__text_hash").alias("text_hash"), "block", slot.cast("long").alias("slot"), (F.col("__rank") % block).cast("int").alias("place"), (slot < empty).alias("in_mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mix: parts and rows follow (slot, place)."""
    order = mix_order(docs, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.struct("slot", "place").alias("__at"))
    # rows equal in doc_id and text stand at the first of their places
    order = order.groupBy("__id", "__hash").agg(F.min("__at").alias("__at"))
    row = F.col("row")
    placed = packed(docs).join(order.hint("shuffle_hash"), row["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(row["text"]) == F.col("__hash")))
    return placed.orderBy("__at.slot", "__at.place").select("row.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_order(docs.select("doc_id", "source", "text")).drop("text_hash")
