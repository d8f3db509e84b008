"""Logical inputs made from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.records import KINDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """Knowledge records: documents with their labels, or without ``status`` and the join that it takes."""
    d = table(spark, sf_dir, "documents")
    if labels:
        d = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    title = F.substring(F.substring_index("text", "\n", 1), 1, 120)
    status = F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 0, "Not-Current").when(F.col("quality") == 1, "active").otherwise("")
    return d.select(
        F.substring(F.sha2(n.cast("string"), 256), 1, 8).alias("id"),
        "doc_id",
        F.col("source").alias("repo"),
        F.col("lang").alias("branch"),
        F.element_at(F.array(*map(F.lit, KINDS)), (n % 6 + 1).cast("int")).alias("kind"),
        title.alias("title"),
        F.col("text").alias("story"),
        F.array("lang", "source").alias("tags"),
        F.array_distinct(F.concat(F.array("lang", "source"), F.split(F.lower(title), " "))).alias("keywords"),
        *([status.alias("status")] if labels else []),
        (n % 7).alias("used_count"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + n * 60), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        (n % 11 == 0).alias("deleted"),
    )


RECORDS = f"""rec AS (
  SELECT substring(sha256(CAST(d.doc_id AS VARCHAR)), 1, 8) AS id, d.doc_id, d.source AS repo, d.lang AS branch,
    ({KINDS!r})[CAST(d.doc_id % 6 + 1 AS INTEGER)] AS kind, substring(split_part(d.text, chr(10), 1), 1, 120) AS title, d.text AS story,
    [d.lang, d.source] AS tags,
    list_distinct([d.lang, d.source] || string_split(lower(substring(split_part(d.text, chr(10), 1), 1, 120)), ' ')) AS keywords,
    CASE WHEN l.toxic = 1 THEN 'superseded' WHEN l.quality = 0 THEN 'Not-Current' WHEN l.quality = 1 THEN 'active' ELSE '' END AS status,
    d.doc_id % 7 AS used_count, strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y-%m-%d %H:%M:%S') AS ts, d.doc_id % 11 = 0 AS deleted
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def adoption_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adoption events: line items, every seventh logged twice."""
    li = table(spark, sf_dir, "lineitem")
    effect = F.when(F.col("l_returnflag") == "R", "fix").when(F.col("l_returnflag") == "A", "decide").when(F.col("l_linestatus") == "O", "locate").otherwise("skim")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    once = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.col("l_partkey").cast("string").alias("entry_id"), effect.alias("effect"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ts"), seq.alias("seq"))
    return once.union(once.where("seq % 7 = 0").withColumn("seq", F.col("seq") + 1000000000000))


ADOPTION = """once AS (
  SELECT l_orderkey || '-' || l_linenumber AS event_id, CAST(l_partkey AS VARCHAR) AS entry_id,
    CASE WHEN l_returnflag = 'R' THEN 'fix' WHEN l_returnflag = 'A' THEN 'decide' WHEN l_linestatus = 'O' THEN 'locate' ELSE 'skim' END AS effect,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ts, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
ev AS (SELECT * FROM once UNION ALL SELECT event_id, entry_id, effect, ts, seq + 1000000000000 FROM once WHERE seq % 7 = 0)"""


def closeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeouts: orders with the parts of their lines in the roles of entries."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("p"), "l_returnflag", "l_linenumber")
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("p"))))
    n = F.col("l_linenumber")
    lists = li.groupBy("l_orderkey").agg(
        pick(n <= 2).alias("used_entry_ids"),
        pick(F.col("l_returnflag") == "R").alias("heated_entry_ids"),
        pick(n <= 3).alias("hit_entry_ids"),
        pick(n == 6).alias("written_entry_ids"),
        pick(n == 7).alias("updated_entry_ids"),
        pick(n == 4).alias("linked_retrieval_ids"),
    )
    o = table(spark, sf_dir, "orders")
    out = o.join(lists, o["o_orderkey"] == lists["l_orderkey"], "left")
    names = [c for c in lists.columns if c != "l_orderkey"]
    return out.select(F.col("o_orderkey").alias("closeout_id"), F.col("o_custkey").alias("session_id"), *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in names), (F.col("o_orderkey") % 4).alias("rag_calls"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("").alias("skipped_reason")).withColumn("hit_count", F.size("hit_entry_ids"))


CLOSEOUTS = """co AS (
  SELECT o_orderkey AS closeout_id, o_custkey AS session_id, coalesce(u, []) AS used_entry_ids, coalesce(h, []) AS heated_entry_ids,
    coalesce(i, []) AS hit_entry_ids, coalesce(w, []) AS written_entry_ids, coalesce(d, []) AS updated_entry_ids, coalesce(r, []) AS linked_retrieval_ids,
    o_orderkey % 4 AS rag_calls, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS skipped_reason, len(coalesce(i, [])) AS hit_count
  FROM orders LEFT JOIN (
    SELECT l_orderkey, list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber <= 2) AS u, list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'R') AS h,
      list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber <= 3) AS i, list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber = 6) AS w,
      list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber = 7) AS d, list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber = 4) AS r
    FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search log: events, their type and the last digit of the user as the query."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws(" ", "event_type", F.concat(F.lit("src"), F.col("user_id") % 25)).alias("query"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("hits"), F.concat(F.lit("repo"), F.col("user_id") % 8).alias("repo"))


SEARCHES = """sl AS (
  SELECT event_type || ' src' || (user_id % 25) AS query, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS hits, 'repo' || (user_id % 8) AS repo FROM events)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query batch: the first two long words of each benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 7)), 1, 2)
    q = b.select(F.col("item_id").alias("query_id"), words.alias("w")).where(F.size("w") > 0)
    return q.select("query_id", F.array_join("w", " ").alias("query"), F.array_distinct(F.concat(F.array(F.array_join("w", " ")), "w")).alias("terms"))


QUERIES = """qr AS (
  SELECT query_id, array_to_string(w, ' ') AS query, list_distinct([array_to_string(w, ' ')] || w) AS terms FROM (
    SELECT item_id AS query_id, list(x ORDER BY i)[1:2] AS w FROM (
      SELECT item_id, x, min(i) AS i FROM (
        SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS x, generate_subscripts(string_split_regex(lower(text), '[^a-z]+'), 1) AS i FROM benchmark)
      WHERE length(x) >= 7 GROUP BY 1, 2) GROUP BY 1))"""


#: The keyword index over records, and the counts of the words sought.
POSTINGS = "po AS (SELECT DISTINCT lower(trim(k)) AS keyword, id, repo || '/' || branch AS bucket FROM (SELECT id, repo, branch, unnest(keywords) AS k FROM rec) WHERE trim(k) <> '')"
COUNTS = "sc AS (SELECT keyword, count(*) AS search_count, max(ts) AS last_search FROM (SELECT ts, unnest(string_split(lower(query), ' ')) AS keyword FROM sl) WHERE keyword <> '' GROUP BY 1)"
