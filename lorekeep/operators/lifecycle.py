"""Closeouts, adoption and challenges: what is valid, what is emitted, and what history says of a prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.records import EFFECTS, HEAT_EFFECTS
from lorekeep.functions.secrets import PATTERNS
from lorekeep.operators.matching import RETRIEVAL_ID
from lorekeep.sources.shared import written

# What a challenge may name as the error and as the action.
ERROR_TYPES = ["record_error", "retrieval_error", "scope_error", "application_error", "evidence_error", "outcome_unknown"]
PROPOSED_ACTIONS = ["keep", "correct", "supersede", "defer"]


def _text(c: Column | str) -> Column:
    return F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))


def _list(c: str) -> Column:
    """The distinct non-blank values of a list, trimmed; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def validate_closeouts(closeouts: DataFrame, briefs: DataFrame) -> DataFrame:
    """closeout_id, error (the first rule broken, or null), rag_calls (given or inferred), used, brief_used, heat, effects: ids trimmed and once each.

    ``closeouts``: closeout_id, rag_calls (null: not given), queries, hit_count, linked_retrieval_ids, legacy_used, locate, decide, fix,
    write, written_entry_ids, updated_entry_ids, hit_entry_ids, skipped_reason.  ``briefs``: entry_id of session briefs, which are used but not heated.
    An entry under several effects keeps the strongest; ``effects`` has an (entry_id, effect) for each used entry.  Brief ids meet the
    closeouts' ids in a join by id, not as a list.
    """
    given = F.coalesce(F.col("linked_retrieval_ids"), F.array().cast("array<string>"))
    links = F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: x != "")
    c = closeouts.select("closeout_id", "rag_calls", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), links.alias("links"), _text("skipped_reason").alias("reason"), *(_list(x).alias(x) for x in ("queries", "legacy_used", *EFFECTS, "written_entry_ids", "updated_entry_ids", "hit_entry_ids")))
    strongest = list(reversed(EFFECTS))
    rank = {e: i for i, e in enumerate([*strongest, "legacy"])}
    ranked = lambda c, r: F.transform(c, lambda x: F.struct(x.alias("entry_id"), F.lit(r).alias("r")))
    named = [ranked(e, rank[e]) for e in strongest] + [ranked("legacy_used", rank["legacy"])]
    uses = c.select("closeout_id", F.explode(F.concat(*named)).alias("u")).select("closeout_id", "u.*").groupBy("closeout_id", "entry_id").agg(F.min("r").alias("r"), F.max(F.col("r") == rank["legacy"]).alias("legacy"))
    of_brief = briefs.select(F.col("entry_id"), F.lit(True).alias("brief")).distinct()
    uses = uses.join(of_brief, "entry_id", "left").withColumn("brief", F.coalesce("brief", F.lit(False)))
    effect = F.element_at(F.array(*map(F.lit, [*strongest, "legacy"])), F.col("r") + 1)
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("entry_id"))))
    warm = ~F.col("brief") & (F.col("legacy") | (F.col("r") < rank["locate"]))
    held = uses.groupBy("closeout_id").agg(pick(~F.col("brief")).alias("used"), pick(F.col("brief")).alias("brief_used"), pick(warm).alias("heat"), F.array_sort(F.collect_set(F.when(~F.col("brief"), F.struct("entry_id", effect.alias("effect"))))).alias("effects"))
    none = F.array().cast("array<string>")
    c = c.join(held, "closeout_id", "left").withColumns({x: F.coalesce(x, none) for x in ("used", "brief_used", "heat")})
    c = c.withColumn("effects", F.coalesce("effects", F.array().cast("array<struct<entry_id:string,effect:string>>")))
    asked = (F.size("queries") > 0) | (F.col("hit_count") > 0)
    calls = F.coalesce(F.col("rag_calls"), F.greatest(F.size("queries"), F.when(F.col("hit_count") > 0, 1).otherwise(0))).cast("bigint")
    acted = F.size(F.concat("used", "brief_used", "written_entry_ids", "updated_entry_ids")) > 0
    error = (
        F.when(F.exists("links", lambda x: ~x.rlike(RETRIEVAL_ID)), "linked_id_invalid")
        .when(F.size(F.array_distinct("links")) < F.size("links"), "linked_id_repeated")
        .when((F.col("rag_calls") == 0) & asked, "calls_zero_but_used")
        .when(F.col("rag_calls") < 0, "calls_negative")
        .when((calls == 0) & (F.size("links") > 0), "linked_without_calls")
        .when((calls > 0) & (F.size("links") != calls), "calls_not_linked")
        .when(~acted & (F.col("reason") == ""), "reason_required")
        .when((F.size("hit_entry_ids") > 0) & (F.size(F.array_except(F.concat("used", "brief_used"), F.col("hit_entry_ids"))) > 0), "used_outside_hits")
    )
    return c.select("closeout_id", error.alias("error"), calls.alias("rag_calls"), "used", "brief_used", "heat", "effects")


def event_id(closeout_id: Column, entry_id: Column, effect: Column) -> Column:
    """The id of an adoption event, so that a replay gives the same id."""
    return F.sha2(F.concat_ws("|", closeout_id.cast("string"), entry_id, effect), 256)


def apply_closeouts(uses: DataFrame, entries: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new events) of the entries that closeouts used.

    ``uses``: closeout_id, entry_id, effect, once each; ``entries``: entry_id, state (of its evidence), snapshots (whether it has some); ``log``:
    event_id of the events there are.  All but ``locate`` need the entry, and fresh evidence where it has snapshots.
    Outcomes: closeout_id, entry_id, effect, event_id, code (0, 2 not found, 7 not fresh), heated, warning.  One entry's failure leaves the others
    of its closeout alone.  Events that are in the log are not new: applying twice gives the same log.
    """
    known = entries.select("entry_id", "state", "snapshots", F.lit(True).alias("found"))
    out = uses.join(known, "entry_id", "left")
    gated = F.col("effect") != "locate"
    code = F.when(gated & F.col("found").isNull(), 2).when(gated & F.col("snapshots") & (F.coalesce("state", F.lit("legacy_unverified")) != "fresh"), 7).otherwise(0)
    out = out.withColumn("code", code).withColumn("warning", gated & (F.col("code") == 0) & (F.coalesce("state", F.lit("legacy_unverified")) == "legacy_unverified"))
    out = out.select("closeout_id", "entry_id", "effect", event_id(F.col("closeout_id"), F.col("entry_id"), F.col("effect")).alias("event_id"), "code", ((F.col("code") == 0) & F.col("effect").isin(HEAT_EFFECTS)).alias("heated"), "warning")
    out = written(out, "outcomes")
    new = out.where("code = 0").join(log.select("event_id"), "event_id", "left_anti").select("event_id", "closeout_id", "entry_id", "effect")
    return out, new


def closeout_status(outcomes: DataFrame) -> DataFrame:
    """closeout_id, status (applied, partial_failure, failed), n_adopted, n_heated, n_failed, n_warnings."""
    good = F.count_if(F.col("code") == 0)
    failed = F.count_if(F.col("code") != 0)
    return outcomes.groupBy("closeout_id").agg(F.when(failed == 0, "applied").when(good > 0, "partial_failure").otherwise("failed").alias("status"), good.alias("n_adopted"), F.count_if("heated").alias("n_heated"), failed.alias("n_failed"), F.count_if("warning").alias("n_warnings"))


def validate_proposals(proposals: DataFrame, queued: DataFrame, max_entries: int = 3) -> DataFrame:
    """seq, proposal_id, status: the first rule that a proposal breaks, ``duplicate``, or ``pending``.

    ``queued``: seq, proposal_id, entry_ids (challenge briefs); ``proposals``: seq, proposal_id, depth, parent_proposal_id, error_type, entry_ids, claim,
    evidence, proposed_action, proposed_change, why_original_failed, fingerprint.  A proposal refers to the latest brief of its id
    that was queued before it: both go into one order by id, so that no brief is paired with all proposals.  Of the valid proposals of one
    fingerprint the first is pending.
    """
    ids = F.array_distinct(F.coalesce("entry_ids", F.array().cast("array<string>")))
    names = ("depth", "parent_proposal_id", "error_type", "claim", "evidence", "proposed_action", "proposed_change", "why_original_failed", "fingerprint")
    p = proposals.select("seq", _text("proposal_id").alias("proposal_id"), F.lit(None).cast("array<string>").alias("brief"), ids.alias("ids"), F.struct(*names).alias("p"))
    q = queued.select("seq", _text("proposal_id").alias("proposal_id"), F.coalesce("entry_ids", F.array().cast("array<string>")).alias("brief"), F.lit(None).cast("array<string>").alias("ids"), F.lit(None).cast(p.schema["p"].dataType).alias("p"))
    before = Window.partitionBy("proposal_id").orderBy("seq", F.col("brief").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = p.unionByName(q).withColumn("brief", F.last("brief", True).over(before)).where("p is not null").select("seq", "proposal_id", "brief", "ids", "p.*")
    secret = F.lit(False)
    for field in ("claim", "evidence", "proposed_change", "why_original_failed"):
        for pattern, _ in PATTERNS.values():
            secret |= F.coalesce(F.col(field).rlike(pattern), F.lit(False))
    action = F.lower(_text("proposed_action"))
    status = (
        F.when((F.coalesce("depth", F.lit(1)) != 1) | (F.coalesce("parent_proposal_id", F.lit("")) != ""), "recursive")
        .when((F.col("proposal_id") == "") | F.col("brief").isNull(), "not_queued")
        .when(~F.coalesce(F.col("error_type"), F.lit("")).isin(ERROR_TYPES), "error_type")
        .when((F.size("ids") < 1) | (F.size("ids") > max_entries), "entry_count")
        .when(F.size(F.array_except("ids", "brief")) > 0, "entries_not_in_brief")
        .when(_text("claim") == "", "claim_required")
        .when(_text("evidence") == "", "evidence_required")
        .when(~action.isin(PROPOSED_ACTIONS), "action")
        .when(action.isin("correct", "supersede") & (_text("proposed_change") == ""), "change_required")
        .when(_text("why_original_failed") == "", "why_required")
        .when(secret, "credentials")
    )
    checked = at.select("seq", "proposal_id", "fingerprint", status.alias("status"))
    first = checked.where("status is null").groupBy("fingerprint").agg(F.min("seq").alias("first_seq"))
    return checked.join(first, "fingerprint", "left").select("seq", "proposal_id", F.coalesce("status", F.when(F.col("seq") == F.col("first_seq"), "pending").otherwise("duplicate")).alias("status"))


def resolution_errors(resolutions: DataFrame, proposals: DataFrame) -> DataFrame:
    """resolution_id, error: an unknown proposal, or no evidence for a decision that isn't deferred; null if valid.

    ``resolutions``: resolution_id, proposal_id, decision, evidence; ``proposals``: proposal_id.
    """
    known = proposals.select(_text("proposal_id").alias("proposal_id"), F.lit(True).alias("known")).distinct()
    r = resolutions.select("resolution_id", _text("proposal_id").alias("proposal_id"), F.lower(_text("decision")).alias("decision"), _text("evidence").alias("evidence"))
    return r.join(known, "proposal_id", "left").select("resolution_id", F.when(F.col("known").isNull(), "unknown_proposal").when((F.col("decision") != "deferred") & (F.col("evidence") == ""), "evidence_required").alias("error"))


def attributed(log: DataFrame) -> DataFrame:
    """session_id, turn_id, seq, message, n_attempts, n_success, n_failed, n_unknown: each message of a session with the retrieval attempts made
    after it in its turn and before the next; attempts before any message of their turn have a null seq.

    ``log``: session_id, turn_id, seq, message (null for calls), attempts, status.
    """
    by = Window.partitionBy("session_id", "turn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_message = F.coalesce(F.col("message"), F.lit("")) != ""
    rows = log.withColumn("at", F.last(F.when(is_message, F.col("seq")), True).over(by))
    n = F.when(is_message, 0).otherwise(F.coalesce("attempts", F.lit(0)))
    of = lambda c: F.sum(F.when(c, n).otherwise(0)).alias
    good, bad = F.col("status") == "success", F.col("status") == "failure"
    return rows.groupBy("session_id", "turn_id", F.col("at").alias("seq")).agg(F.min(F.when(is_message & (F.col("seq") == F.col("at")), F.col("message"))).alias("message"), F.sum(n).alias("n_attempts"), of(F.coalesce(good, F.lit(False)))("n_success"), of(F.coalesce(bad, F.lit(False)))("n_failed"), of(~F.coalesce(good | bad, F.lit(False)))("n_unknown"))


def replayed(segments: DataFrame, should_retrieve: Column) -> DataFrame:
    """session_id and, of its messages: n_segments, n_eligible, n_multi (several in a turn), n_duplicate (the prompt came before), n_observed,
    n_predicted, n_suppressed, n_added, n_attempts, n_unattributed, agreement (null without eligible ones).

    Only messages alone in their turn and not seen before are compared with the prediction, as the others can't tell whose attempts they had.
    Duplicates are found against an aggregated first, so that a session isn't one window.
    """
    lost = segments.where("seq is null").groupBy("session_id").agg(F.sum("n_attempts").alias("n_unattributed"))
    s = segments.where("seq is not null").withColumn("key", F.lower(F.trim(F.regexp_replace("message", r"(?U)\s+", " "))))
    s = s.where("key <> ''").withColumn("predicted", F.coalesce(should_retrieve, F.lit(False)))
    turns = segments.where("seq is not null").groupBy("session_id", "turn_id").agg((F.count(F.lit(1)) > 1).alias("multi"))
    first = s.groupBy("session_id", "key").agg(F.min("seq").alias("first"))
    s = s.join(turns, ["session_id", "turn_id"]).join(first, ["session_id", "key"]).withColumn("again", F.col("seq") > F.col("first"))
    ok, seen, told = ~F.col("again") & ~F.col("multi"), F.col("n_attempts") > 0, F.col("predicted")
    out = s.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(ok).alias("n_eligible"),
        F.count_if("multi").alias("n_multi"),
        F.count_if("again").alias("n_duplicate"),
        F.count_if(ok & seen).alias("n_observed"),
        F.count_if(ok & told).alias("n_predicted"),
        F.count_if(ok & seen & ~told).alias("n_suppressed"),
        F.count_if(ok & ~seen & told).alias("n_added"),
        F.sum(F.when(ok, F.col("n_attempts")).otherwise(0)).alias("n_attempts"),
        F.count_if(ok & (seen == told)).alias("agree"),
    )
    return out.join(lost, "session_id", "left").withColumn("n_unattributed", F.coalesce("n_unattributed", F.lit(0))).withColumn("agreement", F.round(F.try_divide("agree", "n_eligible"), 4)).drop("agree")
