"""Searches in groups, synonyms, records that new ones relate to, retrievals of child sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.operators.retrieval import stale_penalty, top_k
from lorekeep.sources.shared import written

#: How many first characters of a contained title meet those of the other before containment is tested: the most that it has.
GRAMS = (1, 2, 3, 6, 12)
# Words of small changes, and words of changes of direction.
MINOR_WORDS = ["参数调整", "配置微调", "修正错误", "补充说明", "小改动", "优化", "完善", "更新"]
MAJOR_WORDS = ["推翻", "废弃", "改用", "不再", "全部改为", "重新设计", "架构调整", "技术栈切换", "迁移"]
# Fixed value: the form of a retrieval's id.
RETRIEVAL_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"


def expanded(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query (trimmed, lower-cased, distinct), terms: itself, the synonyms of which it is the key, and the first group that holds it.

    ``queries``: query.  ``synonyms``: rank, key, values.  Empty queries go.
    """
    q = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    low = synonyms.select("rank", "key", F.transform("values", F.lower).alias("values"))
    forward = low.select(F.col("key").alias("query"), F.col("values").alias("own"))
    first = low.select(F.explode("values").alias("query"), F.struct("rank", "key", "values").alias("s")).groupBy("query").agg(F.min("s").alias("s"))
    none = F.array().cast("array<string>")
    group = F.when(F.col("s").isNotNull(), F.concat(F.array(F.lower("s.key")), F.col("s.values")))
    found = q.join(forward, "query", "left").join(first, "query", "left")
    return found.select("query", F.array_distinct(F.concat(F.array("query"), F.coalesce("own", none), F.coalesce(group, none))).alias("terms"))


def grouped_search(scores: DataFrame, groups: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """search_id, group, rank, id, score, matched_groups: the best ``k`` of every group of queries.

    ``scores``: query_id (the query's text), id, score.  ``groups``: search_id, group, n (from 1), query.
    A group holds what is among the best ``k`` of one of its queries, ranked by the score against its
    first query; ``matched_groups`` names the groups of a search that hold a record, where there are several.
    """
    best = top_k(scores, records, k).select(F.col("query_id").alias("query"), "id")
    members = best.join(groups, "query").select("search_id", "group", "id").distinct()
    first = groups.where("n = 1").select("search_id", "group", F.col("query").alias("query_id"))
    facts = records.select("id", "used_count", "ts", (-stale_penalty()).cast("bigint").alias("missed"))
    # a group's members are at most k for each of its queries, and a search's groups are few
    seen = members.groupBy("search_id", "id").agg(F.sort_array(F.collect_set("group")).alias("all"))
    scored = members.join(first, ["search_id", "group"]).join(scores, ["query_id", "id"], "left").join(facts, "id").join(seen, ["search_id", "id"])
    scored = scored.withColumn("score", F.coalesce("score", "missed"))
    by = Window.partitionBy("search_id", "group").orderBy(F.desc("score"), F.desc("used_count"), F.desc("ts"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("search_id", "group", "rank", "id", "score", F.when(F.size("all") > 1, F.array_join("all", ",")).alias("matched_groups"))


def _grams(title: Column) -> Column:
    """The distinct parts of a title that have one of the lengths."""
    none = F.array().cast("array<string>")
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.length(title) - n + 1), lambda i: title.substr(i, F.lit(n)))
    parts = [F.when(F.length(title) >= n, of_length(n)).otherwise(none) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def _first(title: Column) -> Column:
    """The first characters of a title, as many as the largest of the lengths that it has."""
    of = F.substring(title, 1, GRAMS[0])
    for n in GRAMS[1:]:
        of = F.when(F.length(title) >= n, F.substring(title, 1, n)).otherwise(of)
    return of


def _contained(short: DataFrame, long: DataFrame, s: str, t: str) -> DataFrame:
    """Rows of ``short`` and ``long`` of a kind where the title of the first is part of the second's; prefixes ``s`` and ``t`` of their columns.

    A contained title's first characters are a part of the other, so they meet by equality.
    """
    short = short.where(f"{s}kind <> '' and {s}title <> ''").withColumn("gram", _first(F.col(f"{s}title"))).withColumn("kind", F.col(f"{s}kind"))
    long = long.where(f"{t}title <> ''").withColumn("gram", F.explode(_grams(F.col(f"{t}title")))).withColumn("kind", F.col(f"{t}kind"))
    return short.join(long, ["kind", "gram"]).where(F.contains(F.col(f"{t}title"), F.col(f"{s}title"))).drop("kind", "gram")


def related(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """id, n_related, related_id: how many existing records a new one relates to, and the newest (ties: the largest id).

    Related are records of one non-empty ``feature_key``, and records of one kind where a title is
    part of the other's, whatever the case.  Both have id, kind, feature_key, title; ``existing`` has ts
    and leaves out archived and deleted records.  Records alike in the three fields
    meet as one class, so that copies are not paired one by one.  Empty and null fields relate to nothing.
    """
    fields = lambda p: [F.coalesce(c, F.lit("")).alias(p + c) for c in ("kind", "feature_key")] + [F.lower(F.coalesce("title", F.lit(""))).alias(p + "title")]
    new = incoming.select("id", *fields("n_"))
    own = ["n_kind", "n_feature_key", "n_title"]
    # both classes are read several times
    classes = written(new.select(*own).distinct(), "new")
    old = existing.select(*fields("o_"), F.struct(F.coalesce("ts", F.lit("")).alias("ts"), "id").alias("at")).groupBy("o_kind", "o_feature_key", "o_title").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
    old = written(old, "old")
    keyed = classes.where("n_feature_key <> ''").join(old, F.col("n_feature_key") == F.col("o_feature_key"))
    cols = [*own, *old.columns]
    pairs = keyed.select(*cols).union(_contained(classes, old, "n_", "o_").select(*cols)).union(_contained(old, classes, "o_", "n_").select(*cols)).distinct()
    found = pairs.groupBy(*own).agg(F.sum("n").alias("n_related"), F.max("at").alias("at"))
    return new.join(found, own, "left").select("id", F.coalesce("n_related", F.lit(0)).cast("bigint").alias("n_related"), F.col("at.id").alias("related_id"))


def upsert_actions(incoming: DataFrame, existing: DataFrame, minor: list[str] = MINOR_WORDS, major: list[str] = MAJOR_WORDS) -> DataFrame:
    """id, action, related_id: a new record replaces the newest related one, keeps it as a milestone that it supersedes, or is appended.

    Words of a small change in title or story replace; else words of a change of direction keep; else it replaces.
    """
    context = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("story", F.lit(""))))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(context, w))
    kept = incoming.select("id", (holds(major) & ~holds(minor)).alias("keeps"))
    action = F.when(F.col("related_id").isNull(), "append").when(F.col("keeps"), "milestone").otherwise("replace")
    return related(incoming, existing).join(kept, "id").select("id", action.alias("action"), "related_id")


def reconcile_scouts(retrievals: DataFrame, links: DataFrame) -> DataFrame:
    """retrieval_id, session_id, outcome, parent_key: what became of every retrieval of a child session, and of links to none.

    ``retrievals``: retrieval_id, session_id, is_subagent, parent_id, forbidden.  ``links``: retrieval_id,
    parent_key (a main session), parent_id (the id by which its children name it).  A child's retrieval is
    ``invalid`` if its id is malformed or not unique or the child must not retrieve, ``linked`` if exactly one
    main session with its parent's id names it, else ``orphan``.  Links without retrieval are ``dangling``.
    Empty ids take no part.  Repeated events of a child count once.
    """
    named = retrievals.withColumn("retrieval_id", F.trim("retrieval_id")).where("retrieval_id <> ''").withColumn("valid", F.col("retrieval_id").rlike(RETRIEVAL_ID))
    # aggregates are written before they are joined, so that no task holds their maps and sorts at once
    again = named.where("valid").groupBy("retrieval_id").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("retrieval_id", F.lit(True).alias("again"))
    again = written(again, "again")
    linked = links.withColumn("retrieval_id", F.trim("retrieval_id")).where("retrieval_id <> ''")
    child = named.where("is_subagent").select("retrieval_id", "session_id", F.trim("parent_id").alias("parent_id"), (~F.col("valid") | F.coalesce("forbidden", F.lit(False))).alias("bad"))
    bad = F.col("bad") | F.coalesce("again", F.lit(False))
    child = written(child.join(again, "retrieval_id", "left").select("retrieval_id", "session_id", "parent_id", bad.alias("bad")), "children")
    invalid = child.where("bad").select("retrieval_id", "session_id").distinct()
    # the ids of the rest are in one event each; one main session is the first and the last
    parents = linked.withColumn("parent_id", F.trim("parent_id")).where("parent_id <> ''").groupBy("retrieval_id", "parent_id").agg(F.min("parent_key").alias("parent_key"), F.max("parent_key").alias("last")).where("parent_key = last").drop("last")
    parents = written(parents, "parents")
    rest = child.where("not bad").join(parents, ["retrieval_id", "parent_id"], "left")
    rest = rest.select("retrieval_id", "session_id", F.when(F.col("parent_key").isNotNull(), "linked").otherwise("orphan").alias("outcome"), "parent_key")
    ids = linked.select("retrieval_id", F.lit(0).alias("known")).union(named.where("valid").select("retrieval_id", F.lit(1)))
    dangling = ids.groupBy("retrieval_id").agg(F.max("known").alias("known")).where("known = 0")
    none = F.lit(None)
    return rest.union(invalid.select("retrieval_id", "session_id", F.lit("invalid"), none)).union(dangling.select("retrieval_id", none, F.lit("dangling"), none))


# What a term in a brief's field counts, in tenths; a term that is not specific counts 4 at most.
BRIEF_WEIGHTS = {"title": 60, "anchors": 50, "queries": 50, "tags": 30, "repo": 25, "branch": 25, "summary": 10}
BRIEF_STRONG = ["title", "anchors", "queries", "tags"]


def brief_search(briefs: DataFrame, terms: list[str], specific: list[str], as_of: str, repo: str = "", branch: str = "", days: int = 2, limit: int = 2, across: bool = False) -> DataFrame:
    """rank, id, score, matched_fields: the best recent briefs for lower-cased terms.

    ``briefs``: id, ts, current, title, summary, repo, branch (text), anchors, queries, tags (arrays).  Only current briefs of
    the last ``days`` before ``as_of`` count, of ``repo`` unless ``across``.  Terms count by the field that holds them; the
    same repository and branch and the last 60 hours add to it.  With specific terms a match of the summary or the
    place alone is none.  Ties: the newest, then the smallest id.  Null fields and times match nothing.
    """
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("ts")
    recent = briefs.where(F.col("current") & (age <= days * 86400))
    if repo and not across:
        recent = recent.where(F.col("repo") == repo)
    text = {f: F.lower(F.coalesce(F.array_join(f, " ") if f in ("anchors", "queries", "tags") else F.col(f), F.lit(""))) for f in BRIEF_WEIGHTS}
    hit = {(f, t): F.contains(text[f], F.lit(t)) for f in BRIEF_WEIGHTS for t in terms if t}
    held = {f: reduce(Column.__or__, [hit[k] for k in hit if k[0] == f], F.lit(False)) for f in BRIEF_WEIGHTS}
    points = reduce(Column.__add__, [F.when(hit[f, t], BRIEF_WEIGHTS[f] if t in specific else min(4, BRIEF_WEIGHTS[f])).otherwise(0) for f, t in hit], F.lit(0))
    if repo:
        points = points + F.when(F.col("repo") == repo, 20).otherwise(0)
    if branch:
        points = points + F.when(F.col("branch") == branch, 10).otherwise(0)
    fresh = F.greatest(F.lit(0.0), 2.5 - F.greatest(F.lit(0), age) / 86400)
    counted = BRIEF_STRONG if specific else BRIEF_WEIGHTS
    found = recent.where(reduce(Column.__or__, [held[f] for f in counted]))
    names = F.array_join(F.array_compact(F.array(*(F.when(held[f], f) for f in BRIEF_WEIGHTS))), ",")
    best = found.select("id", "ts", (points / 10 + fresh).alias("score"), names.alias("matched_fields")).orderBy(F.desc("score"), F.desc("ts"), "id").limit(limit)
    # the rank runs over at most ``limit`` rows
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), F.desc("ts"), "id")).alias("rank"), "id", F.round("score", 4).alias("score"), "matched_fields")


def retrieval_checks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each case: hit_count, irrelevant (slots), irrelevant_rate, and whether it holds what is expected of it.

    ``cases``: case_id, min_hits (null: 1, or 0 where zero is allowed), allow_zero, must_find, forbidden, anchors (arrays),
    max_irrelevant (null: 1).  ``hits``: case_id, entry_id, text.  A hit is irrelevant if a case has anchors and its text
    holds none, whatever the case.  A case without hits stays; null texts hold no anchor.
    """
    held = lambda c: F.coalesce(F.array_contains(c, F.col("entry_id")), F.lit(False))
    text = F.lower(F.coalesce("text", F.lit("")))
    anchors = F.filter("anchors", lambda a: a != "")
    off = (F.coalesce(F.size(anchors), F.lit(0)) > 0) & ~F.coalesce(F.exists(anchors, lambda a: F.contains(text, F.lower(a))), F.lit(False))
    of_case = hits.join(cases.select("case_id", "must_find", "forbidden", "anchors"), "case_id").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("hit_count"), F.count_if(off).alias("irrelevant"), F.count_if(held("must_find")).alias("found"), F.count_if(held("forbidden")).alias("bad"))
    n = lambda c: F.coalesce(c, F.lit(0))
    least = F.coalesce("min_hits", F.when(F.coalesce("allow_zero", F.lit(False)), 0).otherwise(1))
    rate = F.when(n("hit_count") > 0, F.round(F.col("irrelevant") / F.col("hit_count"), 4)).otherwise(0.0)
    out = cases.join(of_case, "case_id", "left").select(
        "case_id",
        n("hit_count").alias("hit_count"),
        n("irrelevant").alias("irrelevant"),
        rate.alias("irrelevant_rate"),
        (n("hit_count") >= least).alias("min_hits_ok"),
        ((n(F.size("must_find")) < 1) | (n("found") > 0)).alias("must_find_ok"),
        (n("bad") == 0).alias("forbidden_ok"),
        (rate <= F.coalesce("max_irrelevant", F.lit(1.0))).alias("irrelevant_rate_ok"),
    )
    return out.withColumn("passed", F.col("min_hits_ok") & F.col("must_find_ok") & F.col("forbidden_ok") & F.col("irrelevant_rate_ok"))


def retrieval_metrics(checks: DataFrame) -> DataFrame:
    """One row over all cases: their number, passes, those with hits, and the shares of passes, of cases with hits and of irrelevant slots."""
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    total, passed, nonempty = F.count(F.lit(1)), F.count_if("passed"), F.count_if(F.col("hit_count") > 0)
    slots = F.coalesce(share(F.sum("irrelevant"), F.sum("hit_count")), F.lit(0.0))
    return checks.agg(total.alias("cases"), passed.alias("passes"), nonempty.alias("nonempty"), share(passed, total).alias("pass_rate"), share(nonempty, total).alias("nonempty_rate"), slots.alias("irrelevant_slot_rate"))
