"""Secrets in JSON lines: every string leaf of a line is searched and redacted, whatever its depth."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.secrets import PATTERNS, may_hold


def _leaves(value: Any, out: list[str]) -> None:
    """Append the string leaves of a JSON value that may hold a secret, in order; keys are no leaves."""
    waiting = [value]  # a stack, so that depth has no limit here
    while waiting:
        v = waiting.pop()
        if isinstance(v, str):
            if may_hold(v):
                out.append(v)
        elif isinstance(v, (list, dict)):
            waiting.extend(reversed(list(v.values()) if isinstance(v, dict) else v))


def _with_leaves(value: Any, leaves: Iterator[str]) -> Any:
    """The value with the leaves that ``_leaves`` gives replaced, in the same order."""
    if isinstance(value, str):
        return next(leaves) if may_hold(value) else value
    if isinstance(value, list):
        return [_with_leaves(v, leaves) for v in value]
    if isinstance(value, dict):
        return {k: _with_leaves(v, leaves) for k, v in value.items()}
    return value


def _parsed(line: str) -> tuple[Any, bool]:
    try:
        return json.loads(line), True
    except (json.JSONDecodeError, RecursionError):
        return line, False


def redacted_leaf(text: Column) -> Column:
    """The redacted text and how many secrets of each kind were replaced, each sought after those before it are replaced."""
    found = []
    for name, (pattern, mark) in PATTERNS.items():
        found.append(F.struct(F.lit(name).alias("kind"), F.regexp_count(text, F.lit(pattern)).alias("n")))
        text = F.regexp_replace(text, pattern, mark)
    return F.struct(text.alias("text"), F.filter(F.array(*found), lambda f: f["n"] > 0).alias("found"))


def scan_lines(lines: DataFrame) -> DataFrame:
    """path, line_no, line (redacted), bad (not JSON: searched as text), kinds, n of every line (path, line_no, line).

    Python only takes lines apart and puts them together again; the patterns run as built-in functions, on those leaves
    that hold what a secret can't do without.  Lines without secrets stay as they are.
    """
    rows = lines.select("path", "line_no", F.coalesce("line", F.lit("")).alias("line"))

    def apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            leaves, bad = [], []
            for line in f.line:
                value, ok = _parsed(line) if line.strip() else ("", True)
                own: list[str] = []
                _leaves(value, own)
                leaves.append(own)
                bad.append(not ok)
            yield f.assign(leaves=leaves, bad=bad)

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(c[0] if bad else json.dumps(_with_leaves(json.loads(line), iter(c)), ensure_ascii=False, separators=(",", ":"))) if n else line for line, c, bad, n in zip(f.line, f.clean, f.bad, f.n, strict=True)]
            yield f.assign(line=out)[["path", "line_no", "line", "bad", "kinds", "n"]]

    taken = rows.mapInPandas(apart, "path string, line_no bigint, line string, leaves array<string>, bad boolean")
    done = taken.withColumn("done", F.transform("leaves", redacted_leaf))
    found = F.flatten(F.transform("done", lambda d: d["found"]))
    done = done.withColumn("found", found).select("path", "line_no", "line", "bad", F.transform("done", lambda d: d["text"]).alias("clean"), F.array_sort(F.array_distinct(F.transform("found", lambda f: f["kind"]))).alias("kinds"), F.aggregate("found", F.lit(0).cast("bigint"), lambda a, f: a + f["n"]).alias("n"))
    return done.mapInPandas(together, "path string, line_no bigint, line string, bad boolean, kinds array<string>, n bigint")


def scan_report(scanned: DataFrame) -> DataFrame:
    """path, changed, match_count, finding_types, invalid_json_lines of each file."""
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds"))))  # at most one set for each choice of kinds
    return scanned.groupBy("path").agg((F.sum("n") > 0).alias("changed"), F.sum("n").alias("match_count"), F.array_join(kinds, ",").alias("finding_types"), F.count_if("bad").alias("invalid_json_lines"))
