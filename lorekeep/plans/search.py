"""Registered queries of grouped searches, synonyms, related records, child sessions and secrets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import evidence as E
from lorekeep.functions import secrets as S
from lorekeep.operators import retrieval as RT
from lorekeep.operators import search as X
from lorekeep.plans.adapters import QUERIES as QUERY_SQL
from lorekeep.plans.adapters import RECORDS, queries, records, table
from lorekeep.plans.base import query

# ---- searches

SCORES = "sco AS (SELECT query_id, id, used_count, ts, CAST(max(CASE WHEN t = q AND lower(title) = t THEN 30 WHEN t = q AND contains(lower(title), t) THEN 18 ELSE 0 END) + least(24, 6 * count(*) FILTER (contains(lower(title), t))) + least(16, 4 * count(*) FILTER (contains(lower(array_to_string(tags, ' ')), t))) + max(CASE WHEN t = q AND contains(lower(story), t) THEN 4 ELSE 0 END) + least(8, count(*) FILTER (contains(lower(story), t))) - max(CASE WHEN lower(status) IN ('superseded', 'archived', 'obsolete') THEN 12 ELSE 0 END) AS BIGINT) AS score FROM rec JOIN (SELECT query_id, query AS q, unnest(terms) AS t FROM qr) ON contains(lower(title), t) OR contains(lower(story), t) OR contains(lower(array_to_string(tags, ' ')), t) GROUP BY 1, 2, 3, 4)"


def scores(spark, sf, batch=queries):
    """Scores of the query batch, and the records."""
    rec, q = records(spark, sf), batch(spark, sf)
    # a query batch is bounded by the caller; its terms go to the tasks in passes
    terms = [r[0] for r in q.select(F.explode("terms")).distinct().collect()]
    return RT.relevance(RT.term_hits(records(spark, sf, labels=False), terms), q, rec), rec


@query("SELECT query_id, id, score FROM sco", RECORDS, QUERY_SQL, SCORES)
def relevance_score(spark, sf):
    return scores(spark, sf)[0]


@query("SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, used_count DESC, ts DESC, id) AS rank FROM sco) WHERE rank <= 5", RECORDS, QUERY_SQL, SCORES)
def ranked_search(spark, sf):
    found, rec = scores(spark, sf)
    return RT.top_k(found, rec, 5)


_TERMS = "CASE WHEN contains(query, ' ') THEN [query, split_part(query, ' ', 1), split_part(query, ' ', 2)] ELSE [query] END"
GROUPS = "gr AS (SELECT query_id AS search_id, 'a' AS grp, 1 AS n, split_part(query, ' ', 1) AS query FROM qr UNION ALL SELECT query_id, 'a', 2, string_split(query, ' ')[-1] FROM qr UNION ALL SELECT query_id, 'b', 1, string_split(query, ' ')[-1] FROM qr UNION ALL SELECT query_id, 'b', 2, query FROM qr)"
GROUP_SCORES = f"""st AS (SELECT id, used_count, ts, CASE WHEN lower(status) IN ('superseded', 'archived', 'obsolete') THEN 12 ELSE 0 END AS stale, lower(title) AS ti, lower(array_to_string(tags, ' ')) AS ta, lower(story) AS s FROM rec),
gs AS (SELECT q, id, used_count, ts, CAST(max(CASE WHEN t = q AND ti = t THEN 30 WHEN t = q AND contains(ti, t) THEN 18 ELSE 0 END) + least(24, 6 * count(*) FILTER (contains(ti, t))) + least(16, 4 * count(*) FILTER (contains(ta, t)))
    + max(CASE WHEN t = q AND contains(s, t) THEN 4 ELSE 0 END) + least(8, count(*) FILTER (contains(s, t))) - max(stale) AS BIGINT) AS score
  FROM st JOIN (SELECT query AS q, unnest({_TERMS}) AS t FROM (SELECT DISTINCT query FROM gr)) ON contains(ti, t) OR contains(ta, t) OR contains(s, t) GROUP BY 1, 2, 3, 4),
be AS (SELECT q, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, used_count DESC, ts DESC, id) AS r FROM gs) WHERE r <= 3),
me AS (SELECT DISTINCT search_id, grp, id FROM gr JOIN be ON gr.query = be.q),
ra AS (SELECT me.search_id, me.grp, me.id, coalesce(gs.score, -st.stale) AS score, row_number() OVER (PARTITION BY me.search_id, me.grp ORDER BY coalesce(gs.score, -st.stale) DESC, st.used_count DESC, st.ts DESC, me.id) AS rank
  FROM me JOIN gr ON gr.search_id = me.search_id AND gr.grp = me.grp AND gr.n = 1 JOIN st ON st.id = me.id LEFT JOIN gs ON gs.q = gr.query AND gs.id = me.id)"""


def _groups(spark, sf):
    """Two groups for each query of the batch: its words, and its last word with the whole."""
    words = F.split("query", " ")
    at = lambda g, n, q: F.struct(F.lit(g).alias("group"), F.lit(n).alias("n"), q.alias("query"))
    first, last = words[0], F.element_at(words, -1)
    q = queries(spark, sf).withColumn("g", F.explode(F.array(at("a", 1, first), at("a", 2, last), at("b", 1, last), at("b", 2, F.col("query")))))
    return q.select(F.col("query_id").alias("search_id"), "g.*")


def _group_queries(spark, sf):
    q = _groups(spark, sf).select("query").distinct()
    return q.select(F.col("query").alias("query_id"), "query", F.array_distinct(F.concat(F.array("query"), F.split("query", " "))).alias("terms"))


@query("SELECT search_id, grp, rank, id, score, CASE WHEN (SELECT count(*) FROM me WHERE me.search_id = ra.search_id AND me.id = ra.id) > 1 THEN 'a,b' END AS matched_groups FROM ra WHERE rank <= 3", RECORDS, QUERY_SQL, GROUPS, GROUP_SCORES)
def grouped_search(spark, sf):
    found, rec = scores(spark, sf, _group_queries)
    return X.grouped_search(found, _groups(spark, sf), rec, 3).withColumnRenamed("group", "grp")


@query(
    """SELECT query, array_to_string(list_filter(l, lambda x, i: NOT list_contains(l[1:i-1], x)), '|') AS terms FROM (
      SELECT qs.query, [qs.query] || coalesce(own.vals, []) || coalesce([lower(fst.key)] || fst.vals, []) AS l FROM qs LEFT JOIN sy own ON own.key = qs.query
      LEFT JOIN (SELECT v, key, vals FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY rank) AS r FROM (SELECT *, unnest(vals) AS v FROM sy)) WHERE r = 1) fst ON fst.v = qs.query)""",
    "sy AS (SELECT min(p_partkey) AS rank, lower(p_brand) AS key, list_sort(list(DISTINCT lower(p_type))) AS vals FROM part WHERE p_size % 5 = 0 GROUP BY 2)",
    "qs AS (SELECT DISTINCT lower(trim(q)) AS query FROM (SELECT unnest([p_brand, ' ' || p_type, p_name]) AS q FROM part) WHERE trim(q) <> '')",
)
def expand_query(spark, sf):
    """Brands as keys of the types of their parts; brands, types and names are sought."""
    part = table(spark, sf, "part")
    synonyms = part.where("p_size % 5 = 0").groupBy(F.lower("p_brand").alias("key")).agg(F.min("p_partkey").alias("rank"), F.sort_array(F.collect_set("p_type")).alias("values"))
    asked = part.select(F.explode(F.array("p_brand", F.concat(F.lit(" "), "p_type"), "p_name")).alias("query"))
    return X.expanded(asked, synonyms).select("query", F.array_join("terms", "|").alias("terms"))


_HYPHENED = lambda c: rf"regexp_replace(lower({c}), '[\s_-]+', '-', 'g')"
_SPECIFIC, _GENERIC = ["tionth", "licens"], ["the"]
_FIELDS = [("title", 500), ("array_to_string(tags, ' ')", 300), ("repo", 300), ("story", 80)]
_HAS = {(t, f): f"contains({_HYPHENED(f)}, '{t}')" if len(t) > 3 else f"regexp_matches({_HYPHENED(f)}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in _SPECIFIC + _GENERIC for f, _ in _FIELDS}
_POINTS = " + ".join(f"CASE WHEN {_HAS[t, f]} THEN {45 if t in _GENERIC else w} ELSE 0 END" for t in _SPECIFIC + _GENERIC for f, w in _FIELDS)
_ANY = lambda terms, worth: " OR ".join(_HAS[t, f] for t in terms for f, w in _FIELDS if w in worth)


@query(
    f"""SELECT id, s OR m AS accepted, (points + CASE WHEN s THEN 500 WHEN m THEN 300 ELSE 0 END) / 100 AS score, CASE WHEN points = 0 THEN 'no match' WHEN s THEN 'strong' WHEN m THEN 'medium' ELSE 'only weak or generic' END AS reason
    FROM (SELECT id, {_ANY(_SPECIFIC, (500,))} AS s, {_ANY(_SPECIFIC, (300,))} AS m, {_POINTS} AS points FROM rec)""",
    RECORDS,
)
def match_quality(spark, sf):
    quality = E.match_quality([F.col("title")], [F.array_join("tags", " "), F.col("repo")], [F.col("story")], _SPECIFIC, _GENERIC)
    return records(spark, sf, labels=False).select("id", quality.alias("q")).select("id", "q.*")


_W = {"title": (60, "lower(title)"), "anchors": (50, "lower(array_to_string(keywords, ' '))"), "queries": (50, "lower(split_part(story, '.', 1))"), "tags": (30, "lower(array_to_string(tags, ' '))"), "repo": (25, "lower(repo)"), "branch": (25, "lower(branch)"), "summary": (10, "lower(story)")}
_ASKED = {"tionth": 60, "licens": 60, "the": 4}
_BRIEF_POINTS = " + ".join(f"CASE WHEN contains({text}, '{t}') THEN {min(w, top)} ELSE 0 END" for t, top in _ASKED.items() for w, text in _W.values())
_BRIEF_HELD = {f: "(" + " OR ".join(f"contains({text}, '{t}')" for t in _ASKED) + ")" for f, (_, text) in _W.items()}


@query(
    f"""SELECT row_number() OVER (ORDER BY score DESC, ts DESC, id) AS rank, id, round(score, 4) AS score, f AS matched_fields FROM (
      SELECT id, ts, ({_BRIEF_POINTS} + CASE WHEN branch = 'en' THEN 10 ELSE 0 END) / 10 + greatest(0.0, 2.5 - greatest(0, age) / CAST(86400 AS DOUBLE)) AS score, array_to_string([{", ".join(f"CASE WHEN {h} THEN '{f}' END" for f, h in _BRIEF_HELD.items())}], ',') AS f
      FROM (SELECT *, date_diff('second', CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-02 00:00:00') AS age FROM rec) WHERE NOT deleted AND age <= 86400 AND ({" OR ".join(_BRIEF_HELD[f] for f in ("title", "anchors", "queries", "tags"))}))
    QUALIFY rank <= 50""",
    RECORDS,
)
def brief_search(spark, sf):
    """Records in the role of briefs, with their first sentence as a query."""
    briefs = records(spark, sf, labels=False).select("id", "ts", (~F.col("deleted")).alias("current"), "title", F.col("story").alias("summary"), "repo", "branch", F.col("keywords").alias("anchors"), F.array(F.substring_index("story", ".", 1)).alias("queries"), "tags")
    return X.brief_search(briefs, list(_ASKED), ["tionth", "licens"], "2024-01-02 00:00:00", branch="en", days=1, limit=50, across=True)


_CHECKS = """hi AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, used_count DESC, ts DESC, id) AS rank FROM sco) WHERE rank <= 5),
cs AS (SELECT query_id AS case_id, CASE WHEN query_id % 4 = 0 THEN query_id % 8 END AS min_hits, query_id % 3 = 0 AS allow_zero, split_part(query, ' ', 1) AS anchor, CASE WHEN query_id % 2 = 0 THEN 0.5 END AS top FROM qr),
cc AS (SELECT case_id, any_value(min_hits) AS m, any_value(allow_zero) AS z, any_value(top) AS top, count(rec.id) AS h, count(*) FILTER (rec.id IS NOT NULL AND NOT contains(lower(story), anchor)) AS ir, coalesce(bool_or(kind = 'map' OR kind = 'issue'), FALSE) AS found, coalesce(bool_or(deleted), FALSE) AS bad
  FROM cs LEFT JOIN hi ON hi.query_id = case_id LEFT JOIN rec ON rec.id = hi.id GROUP BY 1),
ck AS (SELECT case_id, h AS hit_count, ir AS irrelevant, CASE WHEN h > 0 THEN round(ir / h, 4) ELSE 0.0 END AS irrelevant_rate, h >= coalesce(m, CASE WHEN z THEN 0 ELSE 1 END) AS min_hits_ok, h = 0 OR found AS must_find_ok, NOT bad AS forbidden_ok, CASE WHEN h > 0 THEN round(ir / h, 4) ELSE 0.0 END <= coalesce(top, 1.0) AS irrelevant_rate_ok FROM cc),
ca AS (SELECT *, min_hits_ok AND must_find_ok AND forbidden_ok AND irrelevant_rate_ok AS passed FROM ck)"""


def _checks(spark, sf):
    """Cases made of the query batch: maps and issues among their hits are to be found, deleted records are not."""
    rec = records(spark, sf, labels=False).select("id", "kind", "deleted", F.col("story").alias("text"))
    hits = ranked_search(spark, sf).select(F.col("query_id").alias("case_id"), F.col("id").alias("entry_id")).join(rec.withColumnRenamed("id", "entry_id"), "entry_id")
    ids = lambda c: F.collect_list(F.when(c, F.col("entry_id")))
    # of at most five hits a case
    wanted = hits.groupBy("case_id").agg(ids(F.col("kind").isin("map", "issue")).alias("good"), F.count(F.lit(1)).alias("n"), ids(F.col("deleted")).alias("forbidden"))
    i = F.col("case_id")
    cases = queries(spark, sf).select(F.col("query_id").alias("case_id"), F.array(F.split("query", " ")[0]).alias("anchors")).join(wanted, "case_id", "left")
    must = F.when(F.col("n") > 0, F.concat("good", F.array(F.lit("another"))))
    cases = cases.select("case_id", "anchors", must.alias("must_find"), "forbidden", F.when(i % 4 == 0, i % 8).alias("min_hits"), (i % 3 == 0).alias("allow_zero"), F.when(i % 2 == 0, 0.5).alias("max_irrelevant"))
    return X.retrieval_checks(cases, hits.select("case_id", "entry_id", "text"))


@query("SELECT * FROM ca", RECORDS, QUERY_SQL, SCORES, _CHECKS)
def retrieval_check(spark, sf):
    return _checks(spark, sf)


@query("SELECT count(*) AS cases, count(*) FILTER (passed) AS passes, count(*) FILTER (hit_count > 0) AS nonempty, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate, round(count(*) FILTER (hit_count > 0) / count(*), 4) AS nonempty_rate, round(sum(irrelevant) / sum(hit_count), 4) AS irrelevant_slot_rate FROM ca", RECORDS, QUERY_SQL, SCORES, _CHECKS)
def retrieval_metrics(spark, sf):
    return X.retrieval_metrics(_checks(spark, sf))


# ---- new records against old ones

_OLD = "ol AS (SELECT id, kind, substring(title, 1, 24) AS fk, lower(title) AS t, ts FROM rec WHERE NOT deleted AND status <> 'superseded')"
_NEW = "nw AS (SELECT 'new-' || id AS id, CASE WHEN doc_id % 200 = 0 THEN kind ELSE 'map' END AS kind, CASE WHEN doc_id % 300 = 0 THEN substring(title, 1, 24) END AS fk, lower(split_part(title, ',', 1)) AS t, lower(split_part(title, ',', 1) || ' ' || story) AS c FROM rec WHERE doc_id % 100 = 0)"
_PAIRS = "pa AS (SELECT nw.id, ol.id AS old, ol.ts FROM nw JOIN ol ON (nw.fk <> '' AND nw.fk = ol.fk) OR (nw.kind = ol.kind AND nw.t <> '' AND ol.t <> '' AND (contains(nw.t, ol.t) OR contains(ol.t, nw.t))))"
_BEST = "bs AS (SELECT nw.id, nw.c, n, old FROM nw LEFT JOIN (SELECT id, old, row_number() OVER (PARTITION BY id ORDER BY ts DESC, old DESC) AS r, count(*) OVER (PARTITION BY id) AS n FROM pa) p ON p.id = nw.id AND p.r = 1)"


def _incoming(spark, sf):
    """New records: those whose number is divisible by 100 come again, with a part of their title."""
    n = F.col("doc_id")
    return records(spark, sf, labels=False).where(n % 100 == 0).select(
        F.concat(F.lit("new-"), "id").alias("id"),
        F.when(n % 200 == 0, F.col("kind")).otherwise("map").alias("kind"),
        F.when(n % 300 == 0, F.substring("title", 1, 24)).alias("feature_key"),
        F.substring_index("title", ",", 1).alias("title"),
        "story",
    )


def _existing(spark, sf):
    return records(spark, sf).where("not deleted and status <> 'superseded'").withColumn("feature_key", F.substring("title", 1, 24))


@query("SELECT id, coalesce(n, 0) AS n_related, old AS related_id FROM bs", RECORDS, _OLD, _NEW, _PAIRS, _BEST)
def related_records(spark, sf):
    return X.related(_incoming(spark, sf), _existing(spark, sf))


@query("SELECT id, CASE WHEN old IS NULL THEN 'append' WHEN contains(c, 'licens') AND NOT contains(c, 'tionth') THEN 'milestone' ELSE 'replace' END AS action, old AS related_id FROM bs", RECORDS, _OLD, _NEW, _PAIRS, _BEST)
def upsert_records(spark, sf):
    return X.upsert_actions(_incoming(spark, sf), _existing(spark, sf), ["tionth"], ["licens"])


# ---- child sessions

_EVENTS = """re AS (SELECT CASE WHEN l_linenumber = 7 THEN ' ' || l_orderkey || '-6' WHEN l_linenumber = 5 AND l_orderkey % 3 = 0 THEN '-' || l_orderkey ELSE l_orderkey || '-' || l_linenumber END AS rid, o_orderkey AS session_id,
  o_orderkey % 9 <> 0 AS sub, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS parent, o_orderstatus = 'P' AS forbidden FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LINKS = """li AS (SELECT l_orderkey || '-' || l_linenumber AS rid, o_custkey AS pk, CAST(o_custkey AS VARCHAR) AS parent FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2, 6)
  UNION ALL SELECT l_orderkey || '-2', o_custkey + 1000000, CAST(o_custkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 2
  UNION ALL SELECT l_orderkey || '-3', o_custkey + 1, CAST(o_custkey + 1 AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 3
  UNION ALL SELECT 'lost-' || l_orderkey, o_custkey, CAST(o_custkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 4)"""


@query(
    r"""SELECT DISTINCT rid AS retrieval_id, session_id, outcome, CASE WHEN outcome = 'linked' THEN pk END AS parent_key FROM (
      SELECT e.*, k.pk, CASE WHEN NOT e.ok OR e.forbidden OR e.uses > 1 THEN 'invalid' WHEN k.n = 1 AND e.parent <> '' THEN 'linked' ELSE 'orphan' END AS outcome
      FROM e LEFT JOIN (SELECT rid, parent, count(DISTINCT pk) AS n, min(pk) AS pk FROM li GROUP BY 1, 2) k ON k.rid = e.rid AND k.parent = e.parent WHERE e.sub)
    UNION ALL SELECT DISTINCT rid, NULL, 'dangling', NULL FROM li WHERE rid NOT IN (SELECT rid FROM e WHERE ok)""",
    _EVENTS,
    _LINKS,
    r"e AS (SELECT trim(rid) AS rid, session_id, sub, parent, forbidden, regexp_full_match(trim(rid), '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') AS ok, count(*) OVER (PARTITION BY trim(rid)) AS uses FROM re)",
)
def parent_scout_reconcile(spark, sf):
    """Orders as child sessions of their customers; lines as their retrievals and as links to them."""
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), o == F.col("o_orderkey"))
    rid = F.when(n == 7, F.concat(F.lit(" "), o, F.lit("-6"))).when((n == 5) & (o % 3 == 0), F.concat(F.lit("-"), o)).otherwise(F.concat_ws("-", o, n))
    parent = F.when(o % 8 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    events = lines.select(rid.alias("retrieval_id"), o.alias("session_id"), (o % 9 != 0).alias("is_subagent"), parent.alias("parent_id"), (F.col("o_orderstatus") == "P").alias("forbidden"))
    key = F.col("o_custkey")
    link = lambda i, k, p: F.struct(i.alias("retrieval_id"), k.alias("parent_key"), p.cast("string").alias("parent_id"))
    own = link(F.concat_ws("-", o, n), key, key)
    made = F.when(n.isin(1, 6), F.array(own)).when(n == 2, F.array(own, link(F.concat_ws("-", o, n), key + 1000000, key))).when(n == 3, F.array(link(F.concat_ws("-", o, n), key + 1, key + 1))).when(n == 4, F.array(link(F.concat(F.lit("lost-"), o), key, key)))
    return X.reconcile_scouts(events, lines.select(F.explode(made).alias("l")).select("l.*"))


# ---- secrets

_LINE = """ln AS (SELECT c_custkey, c_custkey % 8 AS k, c_name AS nm, lpad(CAST(c_custkey AS VARCHAR), 24, '0') AS d FROM customer)"""
_SHAPE = {
    0: ("' password = \"k9' || d || '\" end'", "' password = \"[REDACTED]\" end'", "credential_assignment"),
    1: ("' Authorization: bearer ab' || d || '=='", "' Authorization: bearer [REDACTED]'", "bearer_token"),
    2: ("' postgres://me:pw' || d || '@host/db'", "' postgres://me:[REDACTED]@host/db'", "url_userinfo"),
    3: ("' (ghp_' || d || ')'", "' ([REDACTED])'", "opaque_token"),
    4: ("' -----BEGIN RSA PRIVATE KEY-----' || d || chr(10) || d || '-----END RSA PRIVATE KEY-----'", "' -----BEGIN PRIVATE KEY-----' || chr(10) || '[REDACTED]' || chr(10) || '-----END PRIVATE KEY-----'", "private_key"),
    5: ("' api_key: \"Your_' || d || '\"'", "' api_key: \"Your_' || d || '\"'", ""),
    6: ("' pwd=abc, mypassword=' || d", "' pwd=abc, mypassword=' || d", ""),
    7: ("' token sk-' || d || ' pwd: z' || d || ';'", "' token [REDACTED] pwd: [REDACTED];'", "credential_assignment,opaque_token"),
}
_CASE = lambda part: "CASE k " + " ".join(f"WHEN {k} THEN {v[part]}" for k, v in _SHAPE.items()) + " END"


def _lines(spark, sf):
    """A log line for each customer, most with a secret."""
    c = table(spark, sf, "customer").select("c_custkey", F.expr("c_custkey % 8").alias("k"), F.col("c_name").alias("nm"), F.expr("lpad(cast(c_custkey as string), 24, '0')").alias("d"))
    return c.select("c_custkey", F.concat("nm", F.expr(_CASE(0))).alias("line"))


@query(f"SELECT c_custkey, nm || {_CASE(1)} AS line FROM ln", _LINE)
def redact(spark, sf):
    return _lines(spark, sf).select("c_custkey", S.redact(F.col("line")).alias("line"))


@query("SELECT c_custkey, CASE k " + " ".join(f"WHEN {k} THEN '{v[2]}'" for k, v in _SHAPE.items()) + " END AS findings FROM ln", _LINE)
def sensitive_findings(spark, sf):
    return _lines(spark, sf).select("c_custkey", F.array_join(S.sensitive_findings(F.col("line")), ",").alias("findings"))
