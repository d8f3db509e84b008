"""Registered queries of evidence, terms, assets, sessions and their verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions import evidence as E
from lorekeep.functions import records as R
from lorekeep.plans.adapters import CLOSEOUTS, RECORDS, closeouts, records, table
from lorekeep.plans.base import query

# ---- terms

_JOINED = r"regexp_replace(lower(story), '[\s_-]+', '-', 'g')"


@query(rf"SELECT id, regexp_matches({_JOINED}, '(^|[^a-z0-9])la([^a-z0-9]|$)') AS short, contains({_JOINED}, 'licen') AS long, contains({_JOINED}, 'of-the') AS joined, contains(lower(story), 'é') AS other FROM rec", RECORDS)
def term_match_text(spark, sf):
    s = F.col("story")
    return records(spark, sf, labels=False).select("id", E.term_matches("la", s).alias("short"), E.term_matches("Licen", s).alias("long"), E.term_matches("of_-the", s).alias("joined"), E.term_matches("é", s).alias("other"))


@query(r"SELECT term, regexp_matches(term, '[a-z][\w-]*\.(py|md|json|ya?ml|toml|java|ts|tsx|js|jsx)$') OR regexp_matches(term, '[/\\_.:-]') AS code_like, count(*) AS n FROM (SELECT unnest(string_split(lower(url), '/')) AS term FROM pages) WHERE term <> '' GROUP BY ALL")
def code_like(spark, sf):
    t = table(spark, sf, "pages").select(F.explode(F.split(F.lower("url"), "/")).alias("term")).where("term <> ''")
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).select("term", E.code_like(F.col("term")).alias("code_like"), "n")


_RISKS = ["license", "password", "Secret", "token", "idiot", "api", "mit"]


@query(f"SELECT doc_id, array_to_string(list_filter({_RISKS!r}, lambda t: contains(lower(text), lower(t)))[1:5], ',') AS matched FROM documents")
def risk_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(E.matched_terms(_RISKS, F.col("text")), ",").alias("matched"))


@query(f"SELECT id, len(list_filter({_RISKS!r}, lambda t: contains(lower(title), lower(t)) OR contains(lower(story), lower(t)) OR len(list_filter(tags, lambda g: contains(lower(g), lower(t)))) > 0)) > 0 AS flagged FROM rec", RECORDS)
def runtime_record_flag(spark, sf):
    """Records whose title, text or tags hold one of some markers."""
    low = [F.lower(c) for c in ("title", "story")]
    held = lambda t: F.contains(low[0], F.lower(t)) | F.contains(low[1], F.lower(t)) | F.exists("tags", lambda g: F.contains(F.lower(g), F.lower(t)))
    return records(spark, sf, labels=False).select("id", F.coalesce(F.exists(F.array(*map(F.lit, _RISKS)), held), F.lit(False)).alias("flagged"))


# ---- records


@query(
    """SELECT id, CASE WHEN s OR m OR w THEN greatest(35, least(95, 45 + CASE WHEN s THEN 28 ELSE 0 END + CASE WHEN m THEN 16 ELSE 0 END + CASE WHEN w THEN 8 ELSE 0 END
      + CASE WHEN used_count * 2 >= 8 THEN 6 WHEN used_count * 2 >= 4 THEN 3 ELSE 0 END + CASE WHEN t THEN 3 ELSE 0 END - CASE WHEN repo <> 'src0' THEN 8 ELSE 0 END)) ELSE 45 END / 100 AS confidence
    FROM (SELECT *, contains(lower(title), 'tion') AS s, list_contains(tags, 'en') AS m, contains(lower(story), 'license') AS w, doc_id % 2 = 0 AS t FROM rec)""",
    RECORDS,
)
def confidence(spark, sf):
    has = lambda c, t: F.contains(F.lower(c), F.lit(t))
    score = E.confidence(has("title", "tion"), F.array_contains("tags", "en"), has("story", "license"), F.col("used_count") * 2, F.col("doc_id") % 2 == 0, F.col("repo") != "src0")
    return records(spark, sf, labels=False).select("id", score.alias("confidence"))


@query("SELECT id, used_count * CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END + CASE WHEN a <= 0 THEN 0.5 WHEN a >= 30 THEN 0.0 ELSE 0.5 * (1 - a / 30) END AS heat FROM (SELECT *, CAST(date_diff('second', CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-08 00:00:00') AS DOUBLE) / 86400 AS a FROM rec)", RECORDS)
def heat_key(spark, sf):
    age = (F.unix_timestamp(F.lit("2024-01-08 00:00:00")) - F.unix_timestamp("ts")).cast("double") / 86400
    penalty = F.when(F.col("doc_id") % 3 == 0, 0.5)
    return records(spark, sf, labels=False).select("id", E.heat(F.col("used_count"), penalty, R.recency_boost(age)).alias("heat"))


@query("SELECT id, sha256(json_object('branch', branch, 'id', id, 'kind', kind, 'repo', repo, 'status', status, 'tags', tags, 'title', title, 'ts', ts)) AS rev FROM rec", RECORDS)
def record_rev(spark, sf):
    """Revision of a record: a hash of its fields in order of their names, without those of use."""
    fields = F.struct("branch", "id", "kind", "repo", "status", "tags", "title", "ts")
    return records(spark, sf).select("id", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256).alias("rev"))


@query(
    """SELECT key, doc_id, how FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, doc_id) AS r FROM (
      SELECT w.key, rec.doc_id, 0 AS rank, 'id' AS how FROM w JOIN rec ON w.key = rec.id
      UNION ALL SELECT w.key, rec.doc_id, 1, 'computed' FROM w JOIN rec ON w.key = substring(sha256(rec.ts || '|' || rec.title), 1, 8))) WHERE r = 1""",
    RECORDS,
    "w AS (SELECT DISTINCT CASE doc_id % 10 WHEN 0 THEN id WHEN 5 THEN substring(sha256(ts || '|' || title), 1, 8) ELSE 'none' || doc_id END AS key FROM rec WHERE doc_id % 5 IN (0, 1))",
)
def find_record(spark, sf):
    """Records looked up by their id, else by the id that time and title give."""
    rec = records(spark, sf, labels=False).select("doc_id", "id", R.entry_id(F.col("ts"), F.col("title")).alias("computed"))
    n = F.col("doc_id") % 10
    wanted = rec.where("doc_id % 5 in (0, 1)").select(F.when(n == 0, F.col("id")).when(n == 5, F.col("computed")).otherwise(F.concat(F.lit("none"), F.col("doc_id"))).alias("key")).distinct()
    found = [wanted.join(rec.withColumnRenamed(c, "key"), "key").select("key", F.struct(F.lit(i).alias("rank"), "doc_id", F.lit(how).alias("how")).alias("hit")) for i, (c, how) in enumerate((("id", "id"), ("computed", "computed")))]
    return found[0].union(found[1]).groupBy("key").agg(F.min("hit").alias("hit")).select("key", "hit.doc_id", "hit.how")


@query(
    "SELECT id, kind, title, CASE WHEN own OR kind <> 'requirement' AND kind NOT IN ('issue', 'pitfall', 'implementation') THEN story END AS story, repo, NOT own AND kind <> 'experience' AS foreign_part FROM (SELECT *, repo = 'src0' AS own FROM rec)",
    RECORDS,
)
def cross_project_projection(spark, sf):
    """Records as another project sees them: generic kinds and maps whole, of mixed kinds only what is transferable."""
    own = F.col("repo") == "src0"
    whole = own | F.col("kind").isin(E.GENERIC_KINDS) | (F.col("kind") == "map") | ~F.col("kind").isin(E.MIXED_KINDS)
    return records(spark, sf, labels=False).select("id", "kind", "title", F.when(whole, F.col("story")).alias("story"), "repo", (~own & ~F.col("kind").isin(E.GENERIC_KINDS)).alias("foreign_part"))


@query("SELECT id, CASE doc_id % 4 WHEN 0 THEN 'legacy' WHEN 1 THEN 'none' WHEN 2 THEN 'none' ELSE CASE WHEN status = 'active' THEN 'strong' ELSE 'stale' END END AS strength FROM rec", RECORDS)
def evidence_strength(spark, sf):
    n = F.col("doc_id") % 4
    types = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("note"))).when(n == 3, F.array(F.lit("note"), F.lit("git_file")))
    return records(spark, sf).select("id", E.evidence_strength(types, F.when(F.col("status") == "active", "fresh").otherwise("changed")).alias("strength"))


@query(
    "SELECT id, unnest(list_filter([CASE WHEN a < 2 OR a > 8 THEN 'aliases' END, CASE WHEN t < 3 OR t > 15 THEN 'trigger_terms' END, CASE WHEN status = '' THEN 'evidence' END], lambda x: x IS NOT NULL)) AS error FROM (SELECT *, least(len(keywords), doc_id % 10) AS a, len(keywords) AS t FROM rec)",
    RECORDS,
)
def strict_record_errors(spark, sf):
    """Rules of strictly checked records: numbers of aliases and trigger terms, and resolvable evidence."""
    a, t = F.least(F.size("keywords"), F.col("doc_id") % 10), F.size("keywords")
    errors = F.array_compact(F.array(F.when((a < 2) | (a > 8), "aliases"), F.when((t < 3) | (t > 15), "trigger_terms"), F.when(F.col("status") == "", "evidence")))
    return records(spark, sf).select("id", F.explode(errors).alias("error"))


@query(
    """SELECT 'invalid_kind' AS problem, id, 1::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN 'bugfix' ELSE kind END AS k, id FROM rec) WHERE k = 'bugfix'
    UNION ALL SELECT 'leftover_type', id, 1 FROM rec WHERE doc_id % 17 = 0
    UNION ALL SELECT 'duplicate_id', substring(sha256(title), 1, 8), count(*) FROM rec GROUP BY 2 HAVING count(*) > 1""",
    RECORDS,
)
def storage_schema_check(spark, sf):
    """Records of an unknown kind or with a former type, and ids that several records have."""
    rec = records(spark, sf, labels=False).select("doc_id", "id", "title", F.when(F.col("doc_id") % 13 == 0, "bugfix").otherwise(F.col("kind")).alias("kind"))
    one = lambda name, where: rec.where(where).select(F.lit(name).alias("problem"), "id", F.lit(1).cast("bigint").alias("n"))
    ids = rec.groupBy(F.substring(F.sha2("title", 256), 1, 8).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return one("invalid_kind", ~F.col("kind").isin(R.KINDS)).union(one("leftover_type", "doc_id % 17 = 0")).union(ids.select(F.lit("duplicate_id"), "id", "n"))


@query(
    """SELECT kind, field, n, first FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, field) AS r FROM (
      SELECT kind, field, count(*) AS n, min(id) AS first FROM (
        SELECT kind, id, unnest(list_filter([CASE WHEN title <> '' THEN 'title' END, 'story', CASE WHEN status <> '' THEN 'status' END, CASE WHEN used_count > 0 THEN 'used_count' END, CASE WHEN deleted THEN 'deleted' END, CASE WHEN len(tags) > 0 THEN 'tags' END], lambda x: x IS NOT NULL)) AS field FROM rec)
      GROUP BY 1, 2)) WHERE r <= 15""",
    RECORDS,
)
def field_discovery(spark, sf):
    """The commonest fields of each kind, with their numbers and an example."""
    named = F.array_compact(F.array(F.when(F.col("title") != "", "title"), F.lit("story"), F.when(F.col("status") != "", "status"), F.when(F.col("used_count") > 0, "used_count"), F.when(F.col("deleted"), "deleted"), F.when(F.size("tags") > 0, "tags")))
    n = records(spark, sf).select("kind", "id", F.explode(named).alias("field")).groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "field"))).where("r <= 15").drop("r")


@query("SELECT k AS keyword, count(DISTINCT CASE WHEN NOT deleted THEN id END) AS n_entries FROM (SELECT id, deleted, unnest(keywords) AS k FROM rec) GROUP BY 1 HAVING bool_or(deleted) AND count(DISTINCT CASE WHEN NOT deleted THEN id END) > 0", RECORDS)
def index_add_remove(spark, sf):
    """Keywords that the removal of records touches, with the entries that they keep; keywords without any are gone."""
    posted = records(spark, sf, labels=False).select("id", "deleted", F.explode("keywords").alias("keyword")).distinct()
    touched = posted.groupBy("keyword").agg(F.bool_or("deleted").alias("touched"), F.count_if(~F.col("deleted")).alias("n_entries"))
    return touched.where("touched and n_entries > 0").select("keyword", "n_entries")


# ---- assets


@query(
    """SELECT case_id, count(*) AS n, count(*) FILTER (state = 'ok') AS n_ok, count(*) FILTER (state = 'file_missing') AS n_missing, count(*) FILTER (state = 'sha256_mismatch') AS n_mismatch, bool_and(state = 'ok') AS ok FROM (
      SELECT m.case_id, CASE WHEN m.sha = '' THEN 'reference_missing' WHEN f.sha IS NULL THEN 'file_missing' WHEN f.sha <> m.sha THEN 'sha256_mismatch' ELSE 'ok' END AS state FROM
        (SELECT lang || '-' || source || '-' || (doc_id % 50) AS case_id, doc_id, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 9 = 0 THEN sha256('x') ELSE sha256(text) END AS sha FROM documents) m
        LEFT JOIN (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 0) f USING (doc_id)) GROUP BY 1"""
)
def asset_verify(spark, sf):
    """Recomputed hashes against a manifest: the state of each asset, and whether all of a case are well."""
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    manifest = d.select(F.concat_ws("-", "lang", "source", n % 50).alias("case_id"), "doc_id", F.when(n % 19 == 0, "").when(n % 9 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("sha"))
    files = d.where(n % 10 != 0).select("doc_id", F.sha2("text", 256).alias("found"))
    state = F.when(F.col("sha") == "", "reference_missing").when(F.col("found").isNull(), "file_missing").when(F.col("found") != F.col("sha"), "sha256_mismatch").otherwise("ok")
    number = lambda s: F.count_if(F.col("state") == s)
    return manifest.join(files, "doc_id", "left").withColumn("state", state).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), number("ok").alias("n_ok"), number("file_missing").alias("n_missing"), number("sha256_mismatch").alias("n_mismatch"), F.bool_and(F.col("state") == "ok").alias("ok"))


@query("SELECT day, 'asset_' || day || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS next_id FROM (SELECT strftime(o_orderdate, '%y%m%d') AS day, max(o_orderkey % 1500) + 1 AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1)")
def next_asset_id(spark, sf):
    """The id after the largest of each day; ids whose suffix isn't a number don't count."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyMMdd").alias("day"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise((F.col("o_orderkey") % 1500).cast("string")).alias("suffix"))
    ids = o.select(F.concat(F.lit("asset_"), "day", F.lit("_"), "suffix").alias("asset_id"))
    n = ids.select(F.split("asset_id", "_")[1].alias("day"), F.split("asset_id", "_")[2].alias("suffix")).where(F.col("suffix").rlike("^[0-9]+$")).groupBy("day").agg((F.max(F.col("suffix").cast("bigint")) + 1).alias("n"))
    return n.select("day", F.concat(F.lit("asset_"), "day", F.lit("_"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))).alias("next_id"))


# ---- events and sessions


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN event_type WHEN user_id % 7 = 0 OR user_id % 11 = 0 THEN 'test' ELSE 'production' END AS runtime_source FROM events")
def runtime_source_filter(spark, sf):
    n = F.col("user_id")
    source = E.runtime_source(F.when(n % 5 == 0, F.concat(F.lit(" "), F.upper("event_type"))), F.when(n % 7 == 0, "TEST"), F.when(n % 11 == 0, " test"))
    return table(spark, sf, "events").select("event_id", source.alias("runtime_source"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN user_id % 3 = 0 WHEN user_id % 2 = 0 THEN event_type = 'click' END AS succeeded FROM events")
def execution_status(spark, sf):
    """Whether commands succeeded, from what they wrote."""
    n, kind = F.col("user_id"), F.col("event_type")
    ended = F.when(kind == "click", "script COMPLETED in 3 s").otherwise("The command failed.")
    output = F.when(kind.isin("error", "signup"), F.concat(F.lit("Process exited with code "), n % 3)).when(n % 2 == 0, ended).otherwise(F.lit("still running"))
    return table(spark, sf, "events").select("event_id", E.execution_status(output).alias("succeeded"))


@query(
    """SELECT conv_id, turn, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') AS turn_id FROM (
      SELECT *, CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 'user-turn-' || sum(CASE WHEN role = 'user' AND turn % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) ELSE 'id-' || turn END END AS own FROM conversations)"""
)
def synthetic_turns(spark, sf):
    """The turn of each message: user messages without an id begin numbered turns."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    user, lacks = F.col("role") == "user", F.col("turn") % 4 == 0
    c = table(spark, sf, "conversations").withColumn("n", F.sum((user & lacks).cast("int")).over(by))
    own = F.when(user & lacks, F.concat(F.lit("user-turn-"), "n")).when(user, F.concat(F.lit("id-"), "turn"))
    return c.withColumn("own", own).select("conv_id", "turn", F.coalesce(F.last("own", True).over(by), F.lit("")).alias("turn_id"))


# Verdicts and scores, the first rule that holds.
_VERDICT_RULES = [
    ("aborted AND NOT used", "turn_aborted", 0),
    ("subagent AND forbidden_used", "subagent_forbidden_but_used", -2),
    ("subagent AND NOT used AND expected", "subagent_kb_task_not_used", -1),
    ("subagent AND NOT used", "subagent_no_kb_expected", 0),
    ("subagent AND authorization_unknown", "subagent_kb_used_authorization_unknown", 0),
    ("subagent AND expected", "subagent_kb_used", 1),
    ("subagent", "subagent_unexpected_kb_used", -1),
    ("forbidden_used", "forbidden_but_used", -2),
    ("NOT retrieved AND expected", "needed_but_not_used", -1),
    ("retrieved AND missing_closeout AND hits <= 0", "used_without_closeout", 0),
    ("retrieved AND missing_closeout", "used_without_closeout", 1),
    ("retrieved AND hits <= 0", "used_no_hit", 0),
    ("hits <= 0 AND used", "kb_used_no_effect_signal", 1),
    ("hits <= 0", "no_kb_needed", 0),
    ("adopted", "used_hit_adopted", 4),
    ("adoption_unconfirmed", "used_hit_adoption_unconfirmed", 2),
    ("wrote", "used_hit_recorded_not_adopted", 3),
    ("true", "used_hit_not_adopted", 2),
]
_FIRST_RULE = "CASE " + " ".join(f"WHEN {when} THEN {i}" for i, (when, _, _) in enumerate(_VERDICT_RULES)) + " END"
_RULES = ", ".join(f"({i}, '{verdict}', {score})" for i, (_, verdict, score) in enumerate(_VERDICT_RULES))
VERDICTS = f"""fl AS (
  SELECT closeout_id, closeout_id % 23 = 0 AS aborted, closeout_id % 3 = 0 AS subagent, closeout_id % 17 = 0 AND rag_calls > 0 AS forbidden_used, closeout_id % 5 < 3 AS expected,
    rag_calls > 0 AS used, closeout_id % 13 = 0 AS authorization_unknown, rag_calls > 1 AS retrieved, skipped_reason = '' AND closeout_id % 4 = 3 AS missing_closeout, hit_count AS hits,
    len(heated_entry_ids) > 0 AS adopted, len(linked_retrieval_ids) > 0 AS adoption_unconfirmed, len(written_entry_ids) + len(updated_entry_ids) > 0 AS wrote FROM co),
ve AS (SELECT closeout_id, subagent, verdict, score FROM (SELECT *, {_FIRST_RULE} AS rule FROM fl) JOIN (VALUES {_RULES}) r(rule, verdict, score) USING (rule))"""


def verdicts(spark, sf):
    """closeout_id, subagent, verdict, score of each session."""
    n, some = F.col("closeout_id"), lambda c: F.size(c) > 0
    flags = closeouts(spark, sf).select(
        n,
        (n % 23 == 0).alias("aborted"),
        (n % 3 == 0).alias("subagent"),
        ((n % 17 == 0) & (F.col("rag_calls") > 0)).alias("forbidden_used"),
        (n % 5 < 3).alias("expected"),
        (F.col("rag_calls") > 0).alias("used"),
        (n % 13 == 0).alias("authorization_unknown"),
        (F.col("rag_calls") > 1).alias("retrieved"),
        ((F.col("skipped_reason") == "") & (n % 4 == 3)).alias("missing_closeout"),
        F.col("hit_count").alias("hits"),
        some("heated_entry_ids").alias("adopted"),
        some("linked_retrieval_ids").alias("adoption_unconfirmed"),
        (some("written_entry_ids") | some("updated_entry_ids")).alias("wrote"),
    )
    return flags.select("closeout_id", "subagent", E.effect_verdict().alias("v")).select("closeout_id", "subagent", "v.verdict", "v.score")


@query("SELECT closeout_id, verdict, score FROM ve", CLOSEOUTS, VERDICTS)
def effect_verdict(spark, sf):
    return verdicts(spark, sf).select("closeout_id", "verdict", "score")


@query(
    "SELECT CASE WHEN grouping(subagent) = 1 THEN 'all' WHEN subagent THEN 'subagent' ELSE 'main' END AS scope, coalesce(verdict, 'all') AS verdict, count(*) AS n, sum(score)::BIGINT AS score, count(*) FILTER (score > 0) AS n_effective FROM ve GROUP BY GROUPING SETS ((subagent, verdict), (subagent), (verdict), ())",
    CLOSEOUTS,
    VERDICTS,
)
def effectiveness_summary(spark, sf):
    """Verdicts and scores of main sessions, subagents and all."""
    v = verdicts(spark, sf).cube("subagent", "verdict").agg(F.grouping("subagent").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("score").cast("bigint").alias("score"), F.count_if(F.col("score") > 0).alias("n_effective"))
    return v.select(F.when(F.col("g") == 1, "all").when(F.col("subagent"), "subagent").otherwise("main").alias("scope"), F.coalesce("verdict", F.lit("all")).alias("verdict"), "n", "score", "n_effective")
