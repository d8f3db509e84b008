"""Which closeout accounts for which retrieval: capacity-limited greedy matching in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.sources.shared import removed, written

#: Fixed value: the form of a retrieval's id.
RETRIEVAL_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
#: How many retrievals a closeout takes in one round at most; more rounds follow.
PER_ROUND = 16


def greedy(candidates: DataFrame, capacity: DataFrame, *kept: str) -> DataFrame:
    """a, b and ``kept`` columns: what one pass over the candidates in order of ``ord`` takes, each ``a`` once and each ``b`` up to its capacity.

    ``candidates``: a, b, ord (unique, comparable); ``capacity``: b, capacity.  A candidate is taken as soon as nothing before it can
    prevent it: it is the first left of its ``a``, and stands among the first of its ``b`` that capacity allows.  The first
    of all always is, so each round takes some; taken rows and full closeouts go by anti-joins.  First candidates are aggregated minima and
    ranks are limited before the shuffle, so a hot group sends a few rows from each task.
    """
    spark = candidates.sparkSession
    left = written(candidates.join(capacity.where("capacity > 0"), "b"), "candidates")
    rounds = []
    while not left.isEmpty():
        first = left.groupBy("a").agg(F.min("ord").alias("ord"))
        by = Window.partitionBy("b").orderBy("ord")
        top = left.withColumn("n", F.row_number().over(by)).where(F.col("n") <= PER_ROUND).where("n <= capacity")
        now = written(top.join(first, ["a", "ord"]).select("a", "b", *kept), "taken")
        rounds.append(now)
        used = now.groupBy("b").agg(F.count(F.lit(1)).alias("used"))
        rest = left.join(now.select("a"), "a", "left_anti").join(used, "b", "left").withColumn("capacity", F.col("capacity") - F.coalesce("used", F.lit(0)))
        old, left = left, written(rest.where("capacity > 0").select(*left.columns), "candidates")
        removed(spark, old.path)
    removed(spark, left.path)
    if not rounds:
        return candidates.select("a", "b", *kept).limit(0)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    done = written(out.coalesce(max(1, min(8, len(rounds)))), "matched")
    removed(spark, *(r.path for r in rounds))
    return done


def normal_query(query: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)\s+", " ")))


def matched(retrievals: DataFrame, closeouts: DataFrame) -> DataFrame:
    """key, session_id, closeout_key, stage of every retrieval: linked by id (``exact``), by turn or query (``fallback``), or neither (null).

    ``retrievals``: key (order of the log), session_id, sequence, turn_id, retrieval_id, query.
    ``closeouts``: key (order), session_id, sequence, turn_id, capacity, linked_retrieval_ids, queries.
    A closeout accounts for earlier retrievals of its session, as many as its capacity.  Links by id go first, those within a turn and then
    nearer ones before others.  Then each retrieval, in order, takes the best of the closeouts left: same turn and query 4, same query 3,
    same turn where either has no query 2; ids that a closeout links and that found no retrieval keep its capacity reserved.
    """
    r = retrievals.select(F.col("key").alias("a"), "session_id", F.col("sequence").alias("seq_a"), F.coalesce("turn_id", F.lit("")).alias("turn_a"), F.trim(F.coalesce("retrieval_id", F.lit(""))).alias("rid"), normal_query(F.col("query")).alias("q"))
    text = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    links = F.array_distinct(F.filter(text("linked_retrieval_ids"), lambda x: F.length(x) > 0))
    asked = F.array_distinct(F.filter(F.transform(text("queries"), normal_query), lambda x: x != ""))
    c = closeouts.select(F.col("key").alias("b"), "session_id", F.col("sequence").alias("seq_b"), F.coalesce("turn_id", F.lit("")).alias("turn_b"), F.greatest("capacity", F.lit(0)).alias("capacity"), links.alias("links"), asked.alias("asked"))
    r, c = written(r, "retrievals"), written(c, "closeouts")
    same_turn = (F.col("turn_a") != "") & (F.col("turn_a") == F.col("turn_b"))

    by_id = c.select("b", "session_id", "seq_b", "turn_b", F.explode("links").alias("rid")).join(r.where(F.col("rid").rlike(RETRIEVAL_ID)), ["session_id", "rid"]).where("seq_b > seq_a")
    order = F.struct(F.when(same_turn, 0).otherwise(1).alias("r"), (F.col("seq_b") - F.col("seq_a")).alias("d"), F.col("a").alias("i"), F.col("b").alias("j"))
    taken = greedy(by_id.select("a", "b", order.alias("ord"), "rid"), c.select("b", "capacity"), "rid")
    exact = taken.select("a", "b")

    found = taken.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.collect_set("rid").alias("ids"))  # at most a capacity of rows each
    reserved = F.size(F.array_except("links", F.coalesce("ids", F.array().cast("array<string>"))))
    rest = written(c.join(found, "b", "left").withColumn("capacity", F.col("capacity") - F.coalesce("n", F.lit(0)) - reserved).where("capacity > 0").drop("n", "ids"), "rest")
    # taken retrievals leave their few columns of candidates, not the log: that one goes into each join as it is
    queried = rest.select("*", F.explode("asked").alias("q")).join(r.where("q <> ''"), ["session_id", "q"]).select("a", "b", "seq_a", "seq_b", "rid", "links", F.when(same_turn, 4).otherwise(3).alias("score"))
    turn = rest.join(r.where("turn_a <> ''"), (rest["session_id"] == r["session_id"]) & (F.col("turn_a") == F.col("turn_b")))
    turn = turn.where((F.col("q") == "") | (F.size("asked") == 0)).select("a", "b", "seq_a", "seq_b", "rid", "links", F.lit(2).alias("score"))
    fits = (F.col("seq_b") > F.col("seq_a")) & ((F.col("rid") == "") | (F.size("links") == 0) | F.array_contains("links", F.col("rid")))
    scored = queried.union(turn).where(fits).select("a", "b", "score").join(exact.select("a"), "a", "left_anti").groupBy("a", "b").agg(F.max("score").alias("score"))
    fallback = greedy(scored.select("a", "b", F.struct(F.col("a").alias("i"), (-F.col("score")).alias("s"), F.col("b").alias("j")).alias("ord")), rest.select("b", "capacity"))

    taken = exact.withColumn("stage", F.lit("exact")).union(fallback.withColumn("stage", F.lit("fallback")))
    return r.select("a", "session_id").join(taken, "a", "left").select(F.col("a").alias("key"), "session_id", F.col("b").alias("closeout_key"), "stage")
