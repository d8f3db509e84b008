"""Registered queries of request contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.operators import context as CX
from lorekeep.plans.adapters import QUERIES as QUERY_SQL
from lorekeep.plans.adapters import RECORDS, queries, records
from lorekeep.plans.base import query
from lorekeep.plans.search import SCORES, scores
from lorekeep.sources.shared import written

LIMIT = 5


def _plans(spark, sf):
    """Two searches for each request: its words together, and its first word."""
    q = queries(spark, sf)
    word = F.substring_index("query", " ", 1)
    of = lambda i, name, weight, text, terms: F.struct(F.lit(i).alias("plan_index"), F.lit(name).alias("name"), F.lit(weight).alias("weight"), text.alias("sought"), terms.alias("own"))
    both = F.array(of(0, "raw", 100, F.col("query"), F.col("terms")), of(1, "first", 50, word, F.array(word)))
    p = q.select("query_id", F.col("terms").alias("all"), F.explode(both).alias("p")).select("query_id", "all", "p.*").where("plan_index = 0 or all[0] <> sought")
    return p.select("query_id", "plan_index", "name", "weight", "sought", "own", F.col("own").alias("specific"), F.array(F.lit("the")).alias("generic"), F.filter("all", lambda t: ~F.contains(t, F.lit(" "))).alias("anchors"))


def _requests(spark, sf):
    n = F.col("query_id")
    return queries(spark, sf).select(
        n,
        F.lit(LIMIT).alias("limit"),
        F.when(F.contains("query", F.lit(" ")), 2).otherwise(1).alias("n_concrete"),
        (n % 3 == 0).alias("fault"),
        (n % 4 == 0).alias("artifact"),
        (n % 7 == 0).alias("decision"),
        (n % 5 == 0).alias("maintenance"),
        (n % 2 == 0).alias("runtime"),
        F.lit("src1").alias("repo"),
        F.when(n % 2 == 0, 0.7).otherwise(0.0).alias("min_confidence"),
        F.when(n % 3 == 1, 0).otherwise(900).alias("max_chars"),
    )


def _sought(spark, sf):
    p = _plans(spark, sf)
    return p.select((F.col("query_id") * 10 + F.col("plan_index")).alias("query_id"), F.col("sought").alias("query"), F.col("own").alias("terms"))


def _inputs(spark, sf):
    found, rec = scores(spark, sf, _sought)
    most = CX.search_limit(F.lit(LIMIT))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("used_count"), F.desc("ts"), "id")
    top = found.join(rec.select("id", "used_count", "ts"), "id").withColumn("r", F.row_number().over(by) - 1).where(F.col("r") < most)
    hits = written(top.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("plan_index"), "id", F.col("r").alias("raw_rank")), "hits")
    story = F.lower("story")
    full = rec.withColumns({"superseded_by": F.when(F.col("doc_id") % 13 == 0, "x"), "runtime": F.contains(story, F.lit("licens")), "decided": (F.col("kind") == "requirement") | (F.col("status") == "active"), "artifact_locator": F.col("doc_id") % 9 == 0})
    return hits, _requests(spark, sf), _plans(spark, sf).drop("sought", "own"), full


_PLANS = """pl AS (SELECT query_id AS rid, 0 AS pi, 'raw' AS name, 100 AS w, query, terms, terms AS all_terms FROM q0 UNION ALL
  SELECT query_id, 1, 'first', 50, split_part(query, ' ', 1), [split_part(query, ' ', 1)], terms FROM q0 WHERE contains(query, ' ')),
qr AS (SELECT rid * 10 + pi AS query_id, query, terms FROM pl)"""
_HAS = lambda f, t: f"contains(regexp_replace(lower({f}), '[\\s_-]+', '-', 'g'), regexp_replace({t}, '[\\s_-]+', '-', 'g'))"
_N = lambda f: f"len(list_filter(terms, lambda t: {_HAS(f, 't')}))"
_THE = lambda f: f"CASE WHEN regexp_matches(lower({f}), '(^|[^a-z0-9])the([^a-z0-9]|$)') THEN 1 ELSE 0 END"
_BUCKET, _TAGS = "concat_ws(' ', repo, branch)", "array_to_string(tags, ' ')"
_JUDGED = f"""hp AS (SELECT query_id // 10 AS rid, query_id % 10 AS pi, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, used_count DESC, ts DESC, id) - 1 AS rr FROM sco QUALIFY rr < {max(4 * LIMIT, LIMIT + 10)}),
j0 AS (
  SELECT hp.*, name, w, rec.kind, title, status, trim(regexp_replace(story, '\\s+', ' ', 'g')) AS su, {_N("title")} AS s1, {_N(_TAGS)} + {_N(_BUCKET)} AS s2, {_N("story")} AS s3,
    {_THE("title")} AS g1, {_THE(_TAGS)} + {_THE(_BUCKET)} AS g2, {_THE("story")} AS g3, len(list_filter(all_terms, lambda t: NOT contains(t, ' ') AND {_HAS(f"concat_ws(' ', title, {_TAGS}, story)", "t")})) AS an,
    len(list_filter(all_terms, lambda t: contains(t, ' '))) > 0 AS two, contains(lower(story), 'licens') AS rt, kind = 'requirement' OR status = 'active' AS dc, doc_id % 9 = 0 AS art, doc_id % 13 = 0 AS sup, repo <> 'src1' AS fo
  FROM hp JOIN pl USING (rid, pi) JOIN rec USING (id)),
j1 AS (SELECT *, 500 * s1 + 300 * s2 + 80 * s3 + 45 * (g1 + g2 + g3) + CASE WHEN s1 > 0 THEN 500 WHEN s2 > 0 THEN 300 ELSE 0 END AS q FROM j0),
j2 AS (
  SELECT *, CASE WHEN s1 + s2 + s3 + g1 + g2 + g3 = 0 THEN 45 ELSE greatest(35, least(95, 45 + CASE WHEN s1 + g1 > 0 THEN 28 ELSE 0 END + CASE WHEN s2 + g2 > 0 THEN 16 ELSE 0 END + CASE WHEN s3 + g3 > 0 THEN 8 ELSE 0 END
      + CASE WHEN q >= 800 THEN 6 WHEN q >= 400 THEN 3 ELSE 0 END - CASE WHEN fo THEN 8 ELSE 0 END)) END AS co,
    CASE WHEN length(su) <= 300 THEN su ELSE rtrim(substring(su, 1, 297)) || '...' END AS summary FROM j1),
j3 AS (
  SELECT *, q + w + co + greatest(0, 25 - rr) - 3 * pi + CASE WHEN rid % 2 <> 0 AND rt THEN -150 ELSE 0 END
      + CASE WHEN rid % 3 = 0 THEN CASE kind WHEN 'issue' THEN 450 WHEN 'pitfall' THEN 400 WHEN 'experience' THEN 250 ELSE 0 END - CASE WHEN rid % 4 = 0 THEN 0 WHEN art THEN 500 WHEN kind = 'map' THEN 250 ELSE 0 END ELSE 0 END
      + CASE WHEN rid % 7 = 0 AND dc THEN 350 ELSE 0 END AS score,
    CASE WHEN status NOT IN ('', 'active') OR sup THEN 'noncurrent' WHEN rid % 5 = 0 AND rt THEN 'runtime_record' WHEN rid % 7 = 0 AND NOT dc THEN 'not_a_decision' WHEN an = 0 THEN 'no_anchor' WHEN rid % 3 = 0 AND two AND an < 2 THEN 'one_anchor'
      WHEN s1 + s2 = 0 THEN 'weak' WHEN fo AND kind IN ('issue', 'pitfall', 'experience', 'implementation') AND summary = '' THEN 'nonactionable' END AS reason FROM j2)"""
_MERGED = f"""mg AS (SELECT rid, id, max(score) AS score, arg_max(co, score * 10 - pi) AS co, array_to_string(list(name ORDER BY pi), ',') AS groups, min(pi * 1000 + rr) AS f, any_value(summary) AS summary,
    any_value(kind) AS kind, any_value(title) AS title, list(name ORDER BY pi) AS gl FROM j3 WHERE reason IS NULL GROUP BY 1, 2),
tp AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, f) AS rank FROM mg WHERE co >= CASE WHEN rid % 2 = 0 THEN 70 ELSE 0 END QUALIFY rank <= {LIMIT}),
sz AS (SELECT *, sum(length(CAST(to_json({{'entry_id': id, 'kind': kind, 'query_groups': gl, 'summary': summary, 'title': coalesce(title, '')}}) AS VARCHAR))) OVER (PARTITION BY rid ORDER BY rank) AS upto FROM tp)"""


@query("SELECT rid AS query_id, reason, count(*) AS n FROM j3 WHERE reason IS NOT NULL GROUP BY 1, 2", RECORDS, QUERY_SQL.replace("qr AS", "q0 AS", 1), _PLANS, SCORES, _JUDGED)
def rag_rejections(spark, sf):
    """How many hits of each request were rejected, and why."""
    return CX.rejected(*_inputs(spark, sf))


@query(
    "SELECT rid AS query_id, rank, id, score / 100 AS score, co / 100 AS confidence, groups AS query_groups FROM sz WHERE rid % 3 = 1 OR upto <= 900",
    RECORDS,
    QUERY_SQL.replace("qr AS", "q0 AS", 1),
    _PLANS,
    SCORES,
    _JUDGED,
    _MERGED,
)
def rag_context(spark, sf):
    """What the benchmark's queries get as requests, the whole items; tests hold the clipped ones against a plain budget."""
    return CX.rag_context(*_inputs(spark, sf)).where("not clipped").drop("summary", "clipped")
