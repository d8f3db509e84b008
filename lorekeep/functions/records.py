"""Column functions on record fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of records, and the kind of each former type.
KINDS = ["map", "experience", "pitfall", "issue", "requirement", "implementation"]
LEGACY_TYPES = {
    "api_endpoint": "map",
    "branch_risk": "pitfall",
    "bugfix": "issue",
    "config_file": "map",
    "database_schema": "map",
    "dependency": "pitfall",
    "dependency_lock": "pitfall",
    "deployment_procedure": "experience",
    "design_rationale": "implementation",
    "env_diff": "pitfall",
    "env_var": "map",
    "external_service_integration": "map",
    "feature_snapshot": "requirement",
    "feature_summary": "requirement",
    "feature_update": "requirement",
    "glossary": "map",
    "note": "requirement",
    "operation_manual": "experience",
    "permission_config": "pitfall",
    "project_feature_index": "requirement",
    "project_structure": "map",
    "sql_script": "map",
    "technical_change": "implementation",
    "technical_decision": "implementation",
    "topic_trace": "requirement",
}
# Statuses that retrieval treats as current, and those that archiving does.
CURRENT_STATUSES = ["", "active", "current", "implemented", "decision_confirmed", "partial_current"]
ARCHIVE_CURRENT = CURRENT_STATUSES[1:]
HEAT_EFFECTS = ["decide", "fix", "write"]
EFFECTS = ["locate", *HEAT_EFFECTS]


def entry_id(ts: Column, title: Column) -> Column:
    """First 8 hex digits of SHA-256 of ``ts|title``."""
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(ts, F.lit("")), F.coalesce(title, F.lit(""))), 256), 1, 8)


def status_value(status: Column) -> Column:
    """Trimmed, lower-cased, hyphens as underscores; null is empty."""
    return F.translate(F.lower(F.trim(F.coalesce(status, F.lit("")))), "-", "_")


def is_current(status: Column, superseded_by: Column) -> Column:
    return status_value(status).isin(CURRENT_STATUSES) & (F.coalesce(superseded_by, F.lit("")) == "")


def legacy_kind(value: Column) -> Column:
    """A valid kind as it is, a former type's kind, else null."""
    pairs = [F.lit(x) for kv in LEGACY_TYPES.items() for x in kv]
    v = F.trim(value)
    return F.when(v.isin(KINDS), v).otherwise(F.create_map(*pairs)[v])


def hash_fraction(task: Column) -> Column:
    """First 64 bits of SHA-256 as a fraction of 2**64."""
    return F.conv(F.substring(F.sha2(task, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def terms(text: Column, pattern: str = r"(?U)[\s,;:/|]+") -> Column:
    """Distinct lower-cased words of two characters and more, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), pattern), lambda x: F.length(x) >= 2))


def clipped(text: Column, limit: int) -> Column:
    """White space collapsed; cut to ``limit`` characters, the last three as dots."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def redact_query(text: Column) -> Column:
    """Secret assignments, provider tokens and private addresses replaced."""
    # The three patterns and their marks.
    t = F.regexp_replace(text, r"(?i)\b(token|password|passwd|secret|api[_-]?key)\b\s*[:=]\s*([^\s,;]+)", "$1=<redacted>")
    t = F.regexp_replace(t, r"\bsk-[A-Za-z0-9_-]{10,}\b", "<redacted-token>")
    return F.regexp_replace(t, r"\b(?:10\.(?:\d{1,3}\.){2}\d{1,3}|192\.168\.(?:\d{1,3}\.)\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.(?:\d{1,3}\.)\d{1,3})\b", "<private-ip>")


def recency_boost(age_days: Column) -> Column:
    """0.5 for a new record, falling to 0 over 30 days."""
    return F.when(age_days <= 0, 0.5).when(age_days >= 30, 0.0).otherwise(0.5 * (1 - age_days / 30))


def first_field_error(kind: Column, title: Column, story: Column, confidence: Column) -> Column:
    """The first broken rule of a record's fields, null if none is."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~F.coalesce(kind.isin(KINDS), F.lit(False)), "invalid_kind").when(blank(title) & blank(story), "no_title_or_story").when(~confidence.between(0, 1), "confidence_range")
