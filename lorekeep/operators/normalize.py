"""Old records brought into today's form, with a code for every change; ids made unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.records import KINDS, legacy_kind
from lorekeep.sources.shared import removed, written

# Fields and markers, and the ends of paths that are primary evidence.
LIST_FIELDS = ["aliases", "key_files", "previous_ids", "source_paths", "tags", "trigger_terms"]
BOOL_FIELDS = ["_archived", "_deleted", "verified"]
TRIGGER_KINDS = ["issue", "map", "pitfall"]
DEFAULT_KIND = "experience"
ARTIFACT_TITLE_MARKERS = ["已生成", "已补齐", "训练卡", "初稿", "参考已沉淀"]
PRIMARY_SUFFIXES = [".py", ".java", ".kt", ".js", ".ts", ".tsx", ".yml", ".yaml", ".toml", ".xml", ".sql", ".log", ".properties", ".gradle", ".gitignore"]
DERIVED_FOLDERS = ["/interview-java-backend/"]
_BETWEEN_WORDS = r"(?U)[\s,，、。；;：:|/\\()\[\]{}<>\"'`]+"
_REFS = "array<struct<type:string,value:string>>"
_PLACES = "array<struct<repo:string,branch:string,branch_dir:string>>"
RAW = ", ".join(f"{f} string" for f in ("id", "kind", "type", "legacy_type", "title", "status", "authority", "evidence_level", "verified_at", "verification_scope", "repo", "branch", "branch_dir", "used_count", "artifact_locator", *LIST_FIELDS, *BOOL_FIELDS)) + f", evidence_refs {_REFS}, previous_location_metadata {_PLACES}"


def _strings(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")


def as_list(raw: Column) -> Column:
    """A JSON array's or a comma list's non-blank values; anything else has none."""
    array = F.from_json(raw, "array<string>")
    return F.when(raw.startswith("["), _strings(F.coalesce(array, F.array().cast("array<string>")))).when(raw.isNull() | raw.rlike(r"^[\{\d]"), F.array().cast("array<string>")).otherwise(_strings(F.split(raw, ",")))


def _first_unlike(values: Column, limit: int) -> Column:
    """The first ``limit`` values that differ in lower case."""
    low = F.transform(values, lambda v: F.lower(v))
    at = F.filter(F.transform(values, lambda v, i: F.when(F.array_position(low, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull())
    return F.slice(at, 1, limit)


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _BETWEEN_WORDS), lambda w: F.trim(w)), lambda w: F.length(w) >= 2)


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def evidence_level(artifact: Column, refs: Column, paths: Column) -> Column:
    """What stands behind a record: an artifact, the user's word, primary files, derived ones, or a mention."""
    low = lambda p: F.lower(p)
    primary = F.exists(paths, lambda p: low(p).rlike("(" + "|".join(s.replace(".", r"\.") for s in PRIMARY_SUFFIXES) + ")$") | F.contains(low(p), F.lit("/src/")))
    derived = F.exists(paths, lambda p: p.startswith("docs/") | F.contains(p, F.lit(DERIVED_FOLDERS[0])))
    talked = F.exists(refs, lambda r: F.coalesce(r["type"], F.lit("")) == "conversation")
    return F.when(artifact, "derived_artifact").when(talked, "canonical_or_user_confirmed").when(primary & derived, "mixed").when(primary, "primary").when(derived, "derived_verified").otherwise("documented")


def authority(artifact: Column, level: Column) -> Column:
    return F.when(artifact, "artifact_locator").when(level == "canonical_or_user_confirmed", "user_confirmed").when(level.isin("primary", "mixed"), "current_evidence").otherwise("verified_summary")


def normalized(records: DataFrame, files: DataFrame) -> DataFrame:
    """The records in today's form, and ``changes``: the codes of what was changed, in order.

    ``records``: key, path, bucket_repo, bucket_branch, raw (a JSON object); ``files``: path of the files that exist, met by a join
    on paths.  Lists in text become arrays, flags booleans; the kind follows from a former type; aliases, triggers and sources are filled in;
    typed sources become references; level, authority and verification follow from the evidence; the bucket's folder is right, and other values go to the history.
    Records in today's form have no changes.
    """
    r = records.withColumn("r", F.from_json("raw", RAW)).select("key", "path", "bucket_repo", "bucket_branch", "r.*")
    codes: list[Column] = []

    def code(when: Column, name: Column | str) -> None:
        codes.append(F.when(F.coalesce(when, F.lit(False)), F.lit(name) if isinstance(name, str) else name))

    for f in LIST_FIELDS:
        code(F.col(f).isNotNull() & ~F.col(f).startswith("["), f"{f}:list")
    flag = lambda f: F.when(F.lower(F.trim(f)).isin("true", "1", "yes", "y"), "true").when(F.lower(F.trim(f)).isin("false", "0", "no", "n"), "false").otherwise(F.col(f))
    for f in BOOL_FIELDS:
        code(flag(f) != F.col(f), f"{f}:bool")
    code(F.col("used_count").isNull(), "used_count")
    known = F.coalesce(F.col("kind"), F.lit("")).isin(KINDS)
    former = F.trim(F.coalesce(F.nullif(F.coalesce(F.col("type"), F.lit("")), F.lit("")), F.col("legacy_type"), F.lit("")))
    valid = F.trim(F.coalesce(F.col("kind"), F.lit(""))).isin(KINDS)
    mapped = F.when(former != "", legacy_kind(former))
    kind = F.when(valid, F.trim("kind")).otherwise(F.coalesce(mapped, F.lit(DEFAULT_KIND)))
    recast = F.col("type").isNotNull() | ~known
    old = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.col("type"))
    code(recast, F.concat(F.lit("kind:"), F.coalesce(old, F.lit("None")), F.lit("->"), kind))
    legacy = F.when(~valid, F.nullif(F.coalesce(F.nullif(former, F.lit("")), F.trim("kind")), F.lit("")))
    keep = F.coalesce(F.when(F.col("type") != kind, F.nullif(F.col("type"), F.lit(""))), F.when(legacy != kind, legacy))
    r = r.withColumns({"new_kind": F.when(recast, kind).otherwise(F.col("kind")), "new_legacy": F.when(recast & F.col("legacy_type").isNull(), keep).otherwise(F.col("legacy_type")), **{f: as_list(F.col(f)) for f in LIST_FIELDS}, **{f: flag(f) for f in BOOL_FIELDS}, "__codes": F.array_compact(F.array(*codes))})

    r = r.withColumn("new_aliases", F.when(F.size("aliases") > 0, F.col("aliases")).otherwise(_first_unlike(F.concat("tags", _words(F.col("title"))), 6)))
    triggers = F.when((F.size("trigger_terms") == 0) & F.col("new_kind").isin(TRIGGER_KINDS), _first_unlike(F.concat("new_aliases", "tags", _words(F.col("title"))), 10)).otherwise(F.col("trigger_terms"))
    sources = F.when((F.size("source_paths") == 0) & (F.size("key_files") > 0), F.col("key_files")).otherwise(F.col("source_paths"))
    r = r.withColumns({"new_triggers": triggers, "given_paths": sources})
    prefix = lambda v: F.lower(F.trim(F.substring_index(v, ":", 1)))
    value = lambda v: F.trim(F.substring(v, F.instr(v, ":") + 1, F.length(v)))
    typed = lambda v: F.contains(v, F.lit(":")) & prefix(v).isin("commit", "conversation") & (value(v) != "")
    found = F.transform(F.filter("given_paths", typed), lambda v: F.struct(F.when(prefix(v) == "commit", "git_commit").otherwise("conversation").alias("type"), value(v).alias("value")))
    held = F.coalesce("evidence_refs", F.array().cast(_REFS))
    r = r.withColumns({"new_paths": F.filter("given_paths", lambda v: ~typed(v)), "found_refs": found, "new_refs": F.concat(held, F.array_except(found, held))})
    artifact = F.lower(F.coalesce("artifact_locator", F.lit("false"))).isin("true", "1")
    made = (F.col("new_kind") == "experience") & F.coalesce(F.col("title"), F.lit("")).rlike("|".join(ARTIFACT_TITLE_MARKERS))
    r = r.withColumns({"made": made, "artifact": artifact | made, "final_kind": F.when(made, "map").otherwise(F.col("new_kind"))})
    r = r.withColumn("level", evidence_level(F.col("artifact"), F.col("new_refs"), F.col("new_paths")))

    wanted = r.select("key", F.explode("new_paths").alias("path")).join(files.select("path").distinct(), "path", "left_semi").select("key").distinct().withColumn("present", F.lit(True))
    r = r.join(wanted, "key", "left")
    present = F.coalesce("present", F.lit(False)) | (F.size("new_refs") > 0)
    verify = present & _blank("verified_at")
    place = F.struct("repo", "branch", "branch_dir")
    right = F.struct(F.col("bucket_repo").alias("repo"), F.col("bucket_branch").alias("branch"), F.col("bucket_branch").alias("branch_dir"))
    moved = ~place.eqNullSafe(right)
    some = (F.coalesce("repo", F.lit("")) != "") | (F.coalesce("branch", F.lit("")) != "") | (F.coalesce("branch_dir", F.lit("")) != "")
    history = F.coalesce("previous_location_metadata", F.array().cast(_PLACES))
    later = [
        F.when((F.size("aliases") == 0) & (F.size("new_aliases") > 0), "aliases"),
        F.when((F.size("trigger_terms") == 0) & (F.size("new_triggers") > 0), "trigger_terms"),
        F.when((F.size("source_paths") == 0) & (F.size("given_paths") > 0), "source_paths"),
        F.when(F.size("new_paths") < F.size("given_paths"), "source_paths:typed_refs"),
        F.when(F.size("found_refs") > 0, "evidence_refs"),
        F.when(F.col("made"), "kind:experience->map:artifact_locator"),
        F.when(_blank("status"), "status"),
        F.when(_blank("evidence_level"), "evidence_level"),
        F.when(_blank("authority"), "authority"),
        F.when(verify, "verified_at"),
        F.when(moved, "bucket_metadata"),
    ]
    return r.select(
        "key",
        "path",
        "id",
        F.col("final_kind").alias("kind"),
        F.col("new_legacy").alias("legacy_type"),
        "title",
        "tags",
        F.col("new_aliases").alias("aliases"),
        F.col("new_triggers").alias("trigger_terms"),
        F.col("new_paths").alias("source_paths"),
        "key_files",
        "previous_ids",
        F.col("new_refs").alias("evidence_refs"),
        *BOOL_FIELDS,
        F.coalesce("used_count", F.lit("0")).alias("used_count"),
        F.col("artifact").alias("artifact_locator"),
        F.when(_blank("status"), "current").otherwise(F.col("status")).alias("status"),
        F.when(_blank("evidence_level"), F.col("level")).otherwise(F.col("evidence_level")).alias("evidence_level"),
        F.when(_blank("authority"), authority(F.col("artifact"), F.col("level"))).otherwise(F.col("authority")).alias("authority"),
        F.when(verify, F.when(F.col("artifact"), "artifact_presence").otherwise("evidence_reference_presence")).otherwise(F.col("verification_scope")).alias("verification_scope"),
        (verify | ~_blank("verified_at")).alias("verified_known"),
        F.col("bucket_repo").alias("repo"),
        F.col("bucket_branch").alias("branch"),
        F.when(moved & some & ~F.array_contains(history, place), F.concat(history, F.array(place))).otherwise(history).alias("previous_location_metadata"),
        F.concat("__codes", F.array_compact(F.array(*later))).alias("changes"),
    )


def unique_ids(records: DataFrame) -> DataFrame:
    """key, id, previous_id: the first holder of an id (by path, then pos) keeps it; the others get one from a hash that no record has.

    ``records``: key, path, pos, id, title.  A new id that any record has, or that goes to an earlier record of the same round, is tried again with the next
    count: taken ids are found by a join, and rounds go on until none is left, so only clashing rows stay in work.
    """
    spark = records.sparkSession
    rows = records.select("key", "path", "pos", F.trim(F.coalesce("id", F.lit(""))).alias("id"), F.coalesce("title", F.lit("")).alias("title"))
    place = F.struct("path", "pos", "key")
    first = rows.where("id <> ''").groupBy("id").agg(F.min(place).alias("first"))
    again = written(rows.join(first, "id").where(place != F.col("first")).select("key", "path", "pos", "id", F.concat_ws("|", "id", "path", "pos", "title").alias("seed")), "again")
    used = written(rows.where("id <> ''").select(F.col("id").alias("new_id")).distinct(), "used")
    done, n, left = [], 1, again
    while not left.isEmpty():
        seed = F.col("seed") if n == 1 else F.concat_ws("|", "seed", F.lit(n))
        tried = left.withColumn("new_id", F.substring(F.sha2(seed, 256), 1, 8))
        free = tried.join(used, "new_id", "left_anti").groupBy("new_id").agg(F.min_by("key", place).alias("key"))
        got = written(free.join(left.select("key", "id"), "key").select("key", "new_id", F.col("id").alias("previous_id")), "new-ids")
        done.append(got)
        used = written(used.union(got.select("new_id")), "used")
        left, n = written(left.join(got.select("key"), "key", "left_anti"), "again"), n + 1
    out = rows.select("key", "id")
    if not done:
        return out.withColumn("previous_id", F.lit(None).cast("string"))
    new = done[0]
    for d in done[1:]:
        new = new.union(d)
    out = written(out.join(new, "key", "left").select("key", F.coalesce("new_id", "id").alias("id"), "previous_id"), "unique")
    removed(spark, again.path, used.path, *(d.path for d in done))
    return out
