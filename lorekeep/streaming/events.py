"""Streaming twins of the event jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.evidence import runtime_source
from lorekeep.operators.usage import closeout_issues

_LISTS = ("used_entry_ids", "heated_entry_ids", "hit_entry_ids", "written_entry_ids", "updated_entry_ids", "linked_retrieval_ids")
CLOSEOUT = "closeout_id bigint, " + ", ".join(f"{c} array<string>" for c in _LISTS) + ", rag_calls bigint, skipped_reason string, hit_count bigint, runtime_source string, routing string, source string"


def daily_activity(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """day, event_type, n in tumbling windows; works on streams and tables."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def adoption_once(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Adoption events without retries of one event_id inside the delay (``ts`` is a timestamp)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def watch_closeouts(closeouts: DataFrame) -> DataFrame:
    """closeout_id, issues, warnings, level (issue, warn, ok); stateless, for streams and tables."""
    level = F.when(F.col("issues") != "", "issue").when(F.col("warnings") != "", "warn").otherwise("ok")
    return closeout_issues(closeouts).withColumn("level", level)


def watch_lines(lines: DataFrame) -> DataFrame:
    """closeout_id, issues, warnings, level of closeouts as JSON lines (``line``); stateless, for streams and tables.

    A line that isn't a JSON object of a closeout is an issue of its own, without closeout_id; events of tests and blank lines are left out.  Fields that a closeout
    lacks count as empty.
    """
    parsed = lines.where(F.trim("line") != "").select(F.from_json("line", f"{CLOSEOUT}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.trim("line").startswith("{").alias("object"))
    bad = F.coalesce(F.col("r._bad").isNotNull() | ~F.col("object"), F.lit(True))
    rows = parsed.select(bad.alias("bad"), "r.*").where(F.col("bad") | (runtime_source(F.col("runtime_source"), F.col("routing"), F.col("source")) != "test"))
    none = F.array().cast("array<string>")
    good = rows.where("not bad").withColumns({c: F.coalesce(c, none) for c in _LISTS} | {c: F.coalesce(c, F.lit(0)) for c in ("rag_calls", "hit_count")} | {"skipped_reason": F.coalesce("skipped_reason", F.lit(""))})
    broken = rows.where("bad").select(F.lit(None).cast("bigint").alias("closeout_id"), F.lit("invalid_json_line").alias("issues"), F.lit("").alias("warnings"), F.lit("issue").alias("level"))
    return watch_closeouts(good).union(broken)
