"""Column functions on evidence, terms, sessions and how a session used records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds that other projects see whole, kinds of which they see the transferable part.
GENERIC_KINDS = ["experience"]
MIXED_KINDS = ["map", "issue", "pitfall", "requirement", "implementation"]
# Types of evidence that can be looked up again.
RESOLVABLE = ["git_file", "git_commit", "file", "directory"]
# Endings and marks of code-like terms, and how a finished command reports itself.
CODE_FILE = r"[a-z][\w-]*\.(py|md|json|ya?ml|toml|java|ts|tsx|js|jsx)$"
CODE_MARK = r"[/\\_.:-]"
EXIT_CODE = r"Process exited with code\s+(-?\d+)"


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def code_like(term: Column) -> Column:
    """File names and terms with path, name or number marks."""
    return term.rlike(CODE_FILE) | term.rlike(CODE_MARK)


def term_matches(term: str, text: Column) -> Column:
    """Whether a term occurs in a text, whatever the case.

    In ASCII terms runs of white space, underscores and hyphens are one hyphen on
    both sides; those of up to three characters must stand alone.
    """
    value, low = term.strip().lower(), F.lower(text)
    if not value:
        return F.lit(False)
    if not all(c.isascii() and (c.isalnum() or c in "_.-") for c in value):
        return F.contains(low, F.lit(value))
    joined = F.regexp_replace(low, r"(?U)[\s_-]+", "-")
    name = re.sub(r"[_-]+", "-", value)
    if len(name) <= 3:
        return joined.rlike(r"(?<![a-z0-9])" + name.replace(".", r"\.") + r"(?![a-z0-9])")
    return F.contains(joined, F.lit(name))


def matched_terms(terms: list[str], text: Column, limit: int = 5) -> Column:
    """The first ``limit`` of the terms that a text holds, whatever the case."""
    low = F.lower(text)
    return F.slice(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t))), 1, limit)


def confidence(strong: Column, medium: Column, weak: Column, quality: Column, trusted: Column, foreign: Column) -> Column:
    """How far a hit is trusted, 0.35 to 0.95: by the fields that matched, the quality of the match, and where the record is from."""
    points = F.when(strong, 28).otherwise(0) + F.when(medium, 16).otherwise(0) + F.when(weak, 8).otherwise(0)
    extra = F.when(quality >= 8, 6).when(quality >= 4, 3).otherwise(0) + F.when(trusted, 3).otherwise(0) - F.when(foreign, 8).otherwise(0)
    return F.when(strong | medium | weak, F.greatest(F.lit(35), F.least(45 + points + extra, F.lit(95)))).otherwise(45) / 100


def evidence_strength(types: Column, state: Column) -> Column:
    """legacy (no field), none, strong (fresh and resolvable) or stale."""
    found = F.arrays_overlap(types, F.array(*map(F.lit, RESOLVABLE)))
    return F.when(types.isNull(), "legacy").when(~found, "none").when(state == "fresh", "strong").otherwise("stale")


def execution_status(output: Column) -> Column:
    """Whether a command succeeded: by its exit code, else by how it says that it ended, else null."""
    code = F.regexp_extract(F.coalesce(output, F.lit("")), EXIT_CODE, 1)
    return F.when(code != "", code.rlike("^-?0+$")).when(output.rlike(r"(?i)\bScript completed\b"), True).when(output.rlike(r"(?i)\b(?:Script failed|command failed)\b"), False)


def runtime_source(runtime: Column, routing: Column, source: Column) -> Column:
    """Where an event is from: its runtime, or ``test`` by its routing or own source, else ``production``."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(plain(runtime) != "", plain(runtime)).when((plain(routing) == "test") | (plain(source) == "test"), "test").otherwise("production")


def heat(used: Column, penalty: Column, boost: Column) -> Column:
    """What ranks records of equal relevance: uses times the penalty of a migration, plus the boost of recency."""
    return used * F.coalesce(penalty, F.lit(1.0)) + boost


#: The flags that a verdict is made from.
VERDICT_FLAGS = ["aborted", "subagent", "forbidden_used", "expected", "used", "authorization_unknown", "retrieved", "missing_closeout", "hits", "adopted", "adoption_unconfirmed", "wrote"]


def effect_verdict() -> Column:
    """(verdict, score) of a session, the first rule that holds, from columns named as ``VERDICT_FLAGS``."""
    c = F.col
    hit = c("hits") > 0
    rules = [
        (c("aborted") & ~c("used"), "turn_aborted", 0),
        (c("subagent") & c("forbidden_used"), "subagent_forbidden_but_used", -2),
        (c("subagent") & c("expected") & ~c("used"), "subagent_kb_task_not_used", -1),
        (c("subagent") & c("used") & c("authorization_unknown"), "subagent_kb_used_authorization_unknown", 0),
        (c("subagent") & c("used") & ~c("expected"), "subagent_unexpected_kb_used", -1),
        (c("subagent") & c("used"), "subagent_kb_used", 1),
        (c("subagent"), "subagent_no_kb_expected", 0),
        (c("forbidden_used"), "forbidden_but_used", -2),
        (c("expected") & ~c("retrieved"), "needed_but_not_used", -1),
        (c("retrieved") & c("missing_closeout") & hit, "used_without_closeout", 1),
        (c("retrieved") & c("missing_closeout"), "used_without_closeout", 0),
        (c("retrieved") & ~hit, "used_no_hit", 0),
        (hit & c("adopted"), "used_hit_adopted", 4),
        (hit & c("adoption_unconfirmed"), "used_hit_adoption_unconfirmed", 2),
        (hit & c("wrote"), "used_hit_recorded_not_adopted", 3),
        (hit, "used_hit_not_adopted", 2),
        (c("used"), "kb_used_no_effect_signal", 1),
    ]
    out = F.struct(F.lit("no_kb_needed").alias("verdict"), F.lit(0).alias("score"))
    for when, verdict, score in reversed(rules):
        out = F.when(when, F.struct(F.lit(verdict).alias("verdict"), F.lit(score).alias("score"))).otherwise(out)
    return out


def match_quality(strong: list[Column], medium: list[Column], weak: list[Column], specific: list[str], generic: list[str], include_weak: bool = False) -> Column:
    """accepted, score, reason: how well terms match the texts of strong, medium and weak fields.

    A specific term counts 5, 3 or 0.8 for each field that holds it, a generic one 0.45.  A record with
    specific terms asked for needs one in a strong (5 more) or medium field (3 more), or, if ``include_weak``,
    in a weak one; without any, a generic term in a strong or medium field.  No match counts 0.
    """
    fields = [(f, level) for level, fs in enumerate((strong, medium, weak)) for f in fs]
    hit = lambda t, f: F.coalesce(term_matches(t, f), F.lit(False))
    any_of = lambda terms, *levels: reduce(Column.__or__, [hit(t, f) for t in terms for f, level in fields if level in levels], F.lit(False))
    points = lambda terms, worth: [F.when(hit(t, f), worth[level]).otherwise(0) for t in terms for f, level in fields]
    total = reduce(Column.__add__, points(specific, (500, 300, 80)) + points(generic, (45, 45, 45)), F.lit(0))
    result = lambda ok, extra, reason: F.struct(F.lit(ok).alias("accepted"), ((total + extra) / 100).alias("score"), F.lit(reason).alias("reason"))
    out = F.when(~any_of([*specific, *generic], 0, 1, 2), result(False, 0, "no match"))
    if specific:
        out = out.when(any_of(specific, 0), result(True, 500, "strong")).when(any_of(specific, 1), result(True, 300, "medium"))
        if include_weak:
            out = out.when(any_of(specific, 2), result(True, 0, "weak"))
        return out.otherwise(result(False, 0, "only weak or generic"))
    return out.when(any_of(generic, 0, 1), result(True, 0, "generic")).otherwise(result(include_weak, 0, "generic weak"))
