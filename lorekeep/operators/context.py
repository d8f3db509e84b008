"""Context for a request: several weighted searches whose hits are tested, scored again, put together and cut to a budget."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.evidence import confidence
from lorekeep.functions.records import CURRENT_STATUSES, clipped, status_value

# What a match is worth in hundredths, by field and for generic terms; what kinds gain when a fault is sought.
STRONG, MEDIUM, WEAK, GENERIC = 500, 300, 80, 45
ACCEPTED_STRONG, ACCEPTED_MEDIUM = 500, 300
FAULT_KINDS = {"issue": 450, "pitfall": 400, "experience": 250}
NEED_SUMMARY = ["issue", "pitfall", "experience", "implementation"]


def search_limit(limit: Column) -> Column:
    """Hits of each search that are looked at for a limit of items."""
    return F.greatest(4 * limit, limit + 10)


def _held(terms: Column, text: Column) -> Column:
    """Those of the (lower-cased) terms that a text holds; terms up to three characters stand alone in it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    joined = F.regexp_replace(low, r"(?U)[\s_-]+", "-")
    apart = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]", " "), F.lit(" "))
    name = lambda t: F.regexp_replace(t, r"[\s_-]+", "-")
    return F.filter(terms, lambda t: F.when(F.length(t) <= 3, F.contains(apart, F.concat(F.lit(" "), t, F.lit(" ")))).otherwise(F.contains(joined, name(t))))


def judged(hits: DataFrame, requests: DataFrame, plans: DataFrame, records: DataFrame) -> DataFrame:
    """Each hit with why it is rejected (``reason``, null if it isn't) and its score in hundredths.

    ``hits``: query_id, plan_index, id, raw_rank (from 0).  ``requests``: query_id, limit, n_concrete (terms of the subject), fault, artifact, decision, maintenance,
    runtime (what the request is about), repo.  ``plans``: query_id, plan_index, name, weight (hundredths), specific, generic (terms), anchors.
    ``records``: id, kind, title, tags, repo, branch, story, status, superseded_by, runtime, decided, artifact_locator.
    A hit is a record of a plan once; requests and plans are met by query, records by id.
    """
    r = records.select("id", "kind", "title", F.array_join("tags", " ").alias("tags"), F.col("repo").alias("of_repo"), "branch", "story", F.col("runtime").alias("is_runtime"), "decided", "artifact_locator", status_value(F.col("status")).alias("state"), F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))
    h = hits.join(plans, ["query_id", "plan_index"]).join(requests, "query_id").join(r, "id")
    strong, medium, weak = [F.col("title")], [F.col("tags"), F.concat_ws(" ", "of_repo", "branch")], [F.col("story")]
    n = lambda terms, fields: sum((F.size(_held(F.col(terms), f)) for f in fields), F.lit(0))
    counts = {f"{t}_{name}": n(t, fields) for t in ("specific", "generic") for name, fields in (("strong", strong), ("medium", medium), ("weak", weak))}
    h = h.withColumns(counts).withColumn("n_anchors", F.size(_held(F.col("anchors"), F.concat_ws(" ", "title", "tags", "story"))))
    c = F.col
    points = STRONG * c("specific_strong") + MEDIUM * c("specific_medium") + WEAK * c("specific_weak") + GENERIC * (c("generic_strong") + c("generic_medium") + c("generic_weak"))
    some_specific = F.size("specific") > 0
    usable = F.when(some_specific, c("specific_strong") + c("specific_medium") > 0).otherwise(c("generic_strong") + c("generic_medium") > 0)
    quality = points + F.when(some_specific & (c("specific_strong") > 0), ACCEPTED_STRONG).when(some_specific & (c("specific_medium") > 0), ACCEPTED_MEDIUM).otherwise(0)
    h = h.withColumns({"usable": usable, "quality": quality, "foreign": c("of_repo") != c("repo"), "summary": clipped(c("story"), 300)})
    any_of = lambda s: (c(f"specific_{s}") + c(f"generic_{s}")) > 0
    h = h.withColumn("confidence", confidence(any_of("strong"), any_of("medium"), any_of("weak"), c("quality") / 100, F.lit(False), c("foreign")))
    mapped = (c("kind") == "map") | c("artifact_locator")
    reason = (
        F.when(~c("state").isin(CURRENT_STATUSES) | (c("superseded_by") != ""), "noncurrent")
        .when(c("maintenance") & c("is_runtime"), "runtime_record")
        .when(c("decision") & ~c("decided"), "not_a_decision")
        .when((F.size("anchors") > 0) & (c("n_anchors") == 0), "no_anchor")
        .when(c("fault") & (c("n_concrete") >= 2) & (c("n_anchors") < 2), "one_anchor")
        .when(mapped & ~c("artifact") & (c("n_anchors") == 0), "map_without_anchor")
        .when(~c("usable"), "weak")
        .when(c("foreign") & c("kind").isin(NEED_SUMMARY) & (c("summary") == ""), "nonactionable")
    )
    kind_boost = F.coalesce(*(F.when(c("kind") == k, v) for k, v in FAULT_KINDS.items()), F.lit(0))
    lost = F.when(c("artifact"), 0).when(c("artifact_locator"), 500).when(c("kind") == "map", 250).otherwise(0)
    score = c("quality") + c("weight") + F.round(c("confidence") * 100).cast("int") + F.greatest(F.lit(0), 25 - c("raw_rank")) - 3 * c("plan_index")
    score += F.when(~c("runtime") & c("is_runtime"), -150).otherwise(0) + F.when(c("fault"), kind_boost - lost).otherwise(0)
    score += F.when(c("decision") & c("decided"), 350 + F.when(c("state") == "decision_confirmed", 100).otherwise(0)).otherwise(0)
    return h.withColumns({"reason": reason, "score": score.cast("bigint")})


def fitted(summary: pd.Series, room: pd.Series) -> pd.Series:
    """The longest clipped form of a summary whose JSON text takes at most ``room`` characters; null if even the empty one doesn't."""

    def one(text: str, most: int) -> str | None:
        best, low, high = None, 0, len(text)
        while low <= high:
            mid = (low + high) // 2
            form = text if mid == len(text) else (text[: max(0, mid - 3)].rstrip() + "..." if mid else "")
            if len(json.dumps(form, ensure_ascii=False)) <= most:
                best, low = form, mid + 1
            else:
                high = mid - 1
        return best

    return pd.Series([one(s or "", int(r)) for s, r in zip(summary, room, strict=True)], dtype=object)


def within_budget(items: DataFrame, max_chars: str = "max_chars") -> DataFrame:
    """The items (query_id, rank, item, summary, and ``max_chars``) of each query that fit: whole ones as long as their JSON texts together take at most
    ``max_chars`` characters (0: all), then the next one with its summary clipped to what is left, if that is shorter; ``clipped`` tells which.

    ``item`` is the JSON text with an empty summary; at most a limit of items for each query.
    """
    by = Window.partitionBy("query_id").orderBy("rank")
    # json_tuple's opposite: the text that JSON takes for a string
    text = F.length(F.to_json(F.struct(F.col("summary").alias("s")))) - 6
    sized = items.withColumn("own", F.length("item") + text - 2).withColumn("upto", F.sum("own").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = (F.col(max_chars) > 0) & (F.col("upto") > F.col(max_chars))
    # the first item that is too long is the last one, if it is kept at all
    sized = sized.withColumn("over", over).withColumn("n_over", F.sum(over.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left = F.col(max_chars) - (F.col("upto") - F.col("own"))
    whole = sized.where("n_over = 0").withColumn("clipped", F.lit(False))
    last = sized.where((F.col("n_over") == 1) & F.col("over") & (left > 0) & (F.col("summary") != "")).withColumn("summary", F.pandas_udf(fitted, "string")("summary", left - F.length("item") + 2)).where("summary is not null").withColumn("clipped", F.lit(True))
    return whole.unionByName(last).drop("own", "upto", "over", "n_over")


def rag_context(hits: DataFrame, requests: DataFrame, plans: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, rank, id, score, confidence, query_groups, summary, clipped: what a request gets.

    Over the columns of ``judged`` requests have min_confidence and max_chars.  A record that several plans found has its best score and the names
    of all; of equal scores the one found first is first.
    """
    good = judged(hits, requests, plans, records).where("reason is null")
    first = F.struct("plan_index", "raw_rank")
    best = F.max_by(F.struct("score", "confidence"), F.struct("score", (-F.col("plan_index")).alias("p")))
    groups = F.transform(F.array_sort(F.collect_set(F.struct("plan_index", "name"))), lambda g: g["name"])  # as many as plans
    merged = good.groupBy("query_id", "id").agg(best.alias("best"), groups.alias("groups"), F.min(first).alias("first"), *(F.first(x).alias(x) for x in ("kind", "title", "summary", "limit", "min_confidence", "max_chars")))
    merged = merged.select("query_id", "id", "best.*", "groups", "first", "kind", "title", "summary", "limit", "min_confidence", "max_chars").where("confidence >= min_confidence")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    top = merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= F.col("limit"))
    top = top.withColumn("item", F.to_json(F.struct(F.col("id").alias("entry_id"), "kind", F.col("groups").alias("query_groups"), F.lit("").alias("summary"), F.coalesce("title", F.lit("")).alias("title"))))
    return within_budget(top).select("query_id", "rank", "id", (F.col("score") / 100).alias("score"), "confidence", F.array_join("groups", ",").alias("query_groups"), "summary", "clipped")


def rejected(hits: DataFrame, requests: DataFrame, plans: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, reason, n: how many hits of a request each rule rejected."""
    return judged(hits, requests, plans, records).where("reason is not null").groupBy("query_id", "reason").agg(F.count(F.lit(1)).alias("n"))
