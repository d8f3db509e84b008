"""Which records were used: adoption events, heat, closeout reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.records import EFFECTS, HEAT_EFFECTS


def adoption_stats(events: DataFrame) -> DataFrame:
    """entry_id, n_events, n_locate.., heated_count, last_used_ts; retries of one event_id count once, the first valid one.

    ``events``: event_id, entry_id, effect, ts, seq (order in the log).
    """
    ok = events.where(F.col("effect").isin(EFFECTS) & (F.trim("event_id") != "") & (F.trim("entry_id") != ""))
    once = ok.groupBy("event_id").agg(F.min(F.struct("seq", "entry_id", "effect", "ts")).alias("e")).select("e.*")
    heats = F.col("effect").isin(HEAT_EFFECTS)
    return once.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        *(F.count_if(F.col("effect") == e).alias(f"n_{e}") for e in EFFECTS),
        F.count_if(heats).alias("heated_count"),
        F.max_by(F.when(heats, F.col("ts")), F.when(heats, F.struct("ts", "seq"))).alias("last_used_ts"),
    )


def heat_join(records: DataFrame, stats: DataFrame) -> DataFrame:
    """Records with ``effective_usage``: own count plus runtime heat."""
    return records.join(stats.select("entry_id", "heated_count"), records["id"] == F.col("entry_id"), "left").withColumn("effective_usage", F.greatest(F.lit(0), F.coalesce("used_count", F.lit(0))) + F.coalesce("heated_count", F.lit(0))).drop("entry_id", "heated_count")


def closeout_issues(closeouts: DataFrame) -> DataFrame:
    """closeout_id, issues, warnings: the checks of one closeout, as comma lists."""
    acted = (F.size("used_entry_ids") + F.size("written_entry_ids") + F.size("updated_entry_ids")) > 0
    outside = F.size(F.array_except("used_entry_ids", "hit_entry_ids")) > 0
    issues = F.array_compact(
        F.array(
            F.when((F.col("hit_count") > 0) & (F.col("rag_calls") <= 0), "hits_without_calls"),
            F.when(~acted & (F.trim("skipped_reason") == ""), "no_action_no_reason"),
            F.when((F.size("hit_entry_ids") > 0) & outside, "used_outside_hits"),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when((F.size("used_entry_ids") > 0) & (F.size(F.array_except("used_entry_ids", "heated_entry_ids")) > 0), "not_fully_heated"),
            F.when((F.col("rag_calls") > 0) & (F.size("linked_retrieval_ids") == 0), "linkage_missing"),
        )
    )
    return closeouts.select("closeout_id", F.array_join(issues, ",").alias("issues"), F.array_join(warnings, ",").alias("warnings"))


def runtime_value_report(closeouts: DataFrame) -> DataFrame:
    """One row: the funnel from closeouts to hits, uses and adoptions, with rates (null without a denominator)."""
    hit, used, adopted = F.col("hit_count") > 0, F.size("used_entry_ids") > 0, F.size("heated_entry_ids") > 0
    out = closeouts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("hits"),
        F.count_if(~hit).alias("no_hits"),
        F.count_if(hit & used).alias("used_hits"),
        F.count_if(hit & adopted).alias("adopted_hits"),
        F.count_if(used & ~adopted).alias("unconfirmed"),
        F.count_if(F.size("written_entry_ids") > 0).alias("written"),
    )
    return out.withColumns({"use_rate": F.round(F.try_divide("used_hits", "hits"), 4), "confirmed_rate": F.round(F.try_divide("adopted_hits", "hits"), 4)})


def effect_precedence(effects: DataFrame) -> DataFrame:
    """closeout_id, entry_id, effect: an entry under several effects keeps the strongest (write, fix, decide, locate)."""
    rank = F.array_position(F.array(*map(F.lit, reversed(EFFECTS))), F.col("effect"))
    return effects.where(F.col("effect").isin(EFFECTS)).groupBy("closeout_id", "entry_id").agg(F.min_by("effect", rank).alias("effect"))


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in the given order; rows of null key are dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
