"""Batch changes of records and checks of stored sets: patches, moves, duplicates, freshness, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def optimistic_update(records: DataFrame, patches: DataFrame) -> DataFrame:
    """doc_id, outcome of each patch (doc_id, expected_rev): applied, stale, or missing without a record (doc_id, record_rev)."""
    found = patches.join(records.select("doc_id", "record_rev"), "doc_id", "left")
    return found.select("doc_id", F.when(F.col("record_rev").isNull(), "missing").when(F.col("record_rev") == F.col("expected_rev"), "applied").otherwise("stale").alias("outcome"))


def migrate(records: DataFrame, moved: Column, target: str) -> DataFrame:
    """Records with moved copies in the bucket ``target`` and deleted originals, in one pass: doc_id, repo, migrated_from, deleted."""
    here = F.struct(F.col("repo").alias("repo"), F.lit(None).cast("string").alias("migrated_from"), (F.col("deleted") | moved).alias("deleted"))
    there = F.struct(F.lit(target).alias("repo"), F.col("repo").alias("migrated_from"), F.lit(False).alias("deleted"))
    return records.select("doc_id", F.explode(F.when(moved, F.array(here, there)).otherwise(F.array(here))).alias("r")).select("doc_id", "r.*")


def rewrite_duplicate_ids(records: DataFrame) -> DataFrame:
    """doc_id, id, previous_id: all but the first holder of an id (smallest doc_id) get a new one.

    The first holder is an aggregated minimum, so an id of many holders isn't one sort.
    """
    first = records.groupBy("id").agg(F.min("doc_id").alias("first"))
    again = F.col("doc_id") != F.col("first")
    new = F.substring(F.sha2(F.concat_ws("|", "id", F.col("doc_id").cast("string")), 256), 1, 8)
    return records.join(first, "id").select("doc_id", F.when(again, new).otherwise(F.col("id")).alias("id"), F.when(again, F.col("id")).alias("previous_id"))


def current_briefs(briefs: DataFrame, keep: int = 3) -> DataFrame:
    """doc_id, state: the newest 1 to 3 briefs of a bucket are current, the others rolled off; without a bucket untouched.

    The ranks are limited before the shuffle, so a hot bucket sends a few rows only.
    """
    w = Window.partitionBy("repo", "branch").orderBy(F.desc("ts"), F.desc("id"), "doc_id")
    newest = briefs.select("doc_id", "repo", "branch", "ts", "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(1, min(3, keep))).select("doc_id", F.lit(True).alias("kept"))
    state = F.when(F.col("repo").isNull() & F.col("branch").isNull(), "untouched").when(F.col("kept"), "current").otherwise("rolled_off_current")
    return briefs.select("doc_id", "repo", "branch").join(newest, "doc_id", "left").select("doc_id", state.alias("state"))


def id_changes(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, change: ids that are new or missing against an earlier set; a full join, no lists."""
    a = before.select(*keys, F.lit(True).alias("old")).distinct()
    b = now.select(*keys, F.lit(True).alias("cur")).distinct()
    return a.join(b, keys, "full").where("old is null or cur is null").select(*keys, F.when(F.col("old").isNull(), "new").otherwise("missing").alias("change"))


def aggregation_freshness(before: DataFrame, now: DataFrame) -> DataFrame:
    """keyword, n_new, n_missing, is_fresh of keyword views made from ``before`` (keyword, id) against ``now``."""
    views = before.select("keyword").distinct()
    changes = id_changes(before, now, ["keyword", "id"]).groupBy("keyword").agg(F.count_if(F.col("change") == "new").alias("n_new"), F.count_if(F.col("change") == "missing").alias("n_missing"))
    return views.join(changes, "keyword", "left").select("keyword", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_new", "n_missing")), F.col("n_new").isNull().alias("is_fresh"))


def adoption_proofs(candidates: DataFrame, events: DataFrame, heat: list[str]) -> DataFrame:
    """closeout_id, entry_id, proof_event_id, proven: the first heat event of the session for each candidate."""
    proof = events.where(F.col("effect").isin(heat)).groupBy("closeout_id", "entry_id").agg(F.min(F.struct("seq", "event_id")).alias("p"))
    return candidates.join(proof, ["closeout_id", "entry_id"], "left").select("closeout_id", "entry_id", F.col("p.event_id").alias("proof_event_id"), F.col("p").isNotNull().alias("proven"))


def evidence_freshness(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """record_id, state, n_snapshots: the worst state (missing, changed, fresh) of a record's snapshots.

    ``snapshots``: record_id, path, size; ``current``: path, limit.
    """
    state = F.when(F.col("limit").isNull(), 2).when(F.col("size") > F.col("limit"), 1).otherwise(0)
    worst = snapshots.join(current, "path", "left").groupBy("record_id").agg(F.max(state).alias("s"), F.count(F.lit(1)).alias("n_snapshots"))
    return worst.select("record_id", F.element_at(F.array(*map(F.lit, ("fresh", "changed", "missing"))), F.col("s") + 1).alias("state"), "n_snapshots")


def label_review(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """outcome, n: what people's labels (doc_id, positive) say of an auditor's flags (doc_id, flagged)."""
    yes, known = F.col("positive"), F.col("positive").isNotNull()
    outcome = F.when(F.col("flagged") & ~known, "unreviewed").when(F.col("flagged") & yes, "confirmed").when(F.col("flagged"), "false_positive").when(known & yes, "confirmed_not_flagged").otherwise("clear")
    return flags.join(labels, "doc_id", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def call_outputs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, output: each user's turn with the last answer before the next one (null without any)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    at = turns.withColumn("call", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w))
    out = at.where((F.col("role") == "assistant") & F.col("call").isNotNull()).groupBy("conv_id", F.col("call").alias("turn")).agg(F.max(F.struct("turn", "text")).alias("o"))
    return turns.where("role = 'user'").select("conv_id", "turn").join(out.select("conv_id", "turn", F.col("o.text").alias("output")), ["conv_id", "turn"], "left")
