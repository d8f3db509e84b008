"""Folders of session logs parsed again only where files changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.shared import exists, written

#: Files that one read names; more reads follow.
PATHS_PER_READ = 1000


def listing(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """path, length, mtime of the files below ``root`` that hold bytes; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("mtime"))


def session_summary(lines: DataFrame) -> DataFrame:
    """path, n_rows, n_bad, n_user, n_assistant of the lines (path, line) of session logs."""
    role = F.get_json_object("line", "$.role")
    bad = (F.trim("line") != "") & F.try_parse_json("line").isNull()
    return lines.groupBy("path").agg(F.count_if(F.trim("line") != "").alias("n_rows"), F.count_if(bad).alias("n_bad"), F.count_if(role == "user").alias("n_user"), F.count_if(role == "assistant").alias("n_assistant"))


class SessionState:
    """What is known of each file (path, length, mtime, parser version) and the rows parsed from it, a version for each run."""

    def __init__(self, spark: SparkSession, root: str, parser_version: str, parse: Callable[[DataFrame], DataFrame] = session_summary) -> None:
        self.spark, self.root, self.parser_version, self.parse = spark, root, parser_version, parse

    def _at(self, run: int, what: str) -> str:
        return f"{self.root}/run={run}/{what}"

    def runs(self) -> int:
        """Whole runs so far; a run that failed half-way is written again."""
        n = 0
        while exists(self.spark, self._at(n, "files/_SUCCESS")):
            n += 1
        return n

    def rows(self) -> DataFrame:
        """The parsed rows of all files of the last run."""
        return self.spark.read.parquet(self._at(self.runs() - 1, "rows"))

    def run(self, sessions: str, glob: str = "*.jsonl") -> DataFrame:
        """path, outcome of each file: ``parsed`` (new, changed, or by another parser version), ``reused`` or ``removed``.

        Only parsed files are opened.  Rows of the others are carried over, those of removed files dropped.
        """
        spark, n = self.spark, self.runs()
        now = written(listing(spark, sessions, glob).withColumn("parser_version", F.lit(self.parser_version)), "listing")
        old = spark.read.parquet(self._at(n - 1, "files")) if n else now.limit(0)
        same = ["path", "length", "mtime", "parser_version"]
        changed = now.join(old, same, "left_anti").select("path")
        # Spark's file index holds the paths of what it reads on the driver as well
        paths = [r.path for r in changed.collect()]
        parts = [self._parsed(paths[i : i + PATHS_PER_READ]) for i in range(0, len(paths), PATHS_PER_READ)]
        if n:
            parts.append(spark.read.parquet(self._at(n - 1, "rows")).join(now.join(old, same, "left_semi").select("path"), "path", "left_semi"))
        rows = parts[0] if parts else self._parsed([])
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows.write.mode("overwrite").parquet(self._at(n, "rows"))
        now.write.mode("overwrite").parquet(self._at(n, "files"))
        gone = old.select("path").join(now, "path", "left_anti").withColumn("outcome", F.lit("removed"))
        reused = now.join(old, same, "left_semi").select("path").withColumn("outcome", F.lit("reused"))
        return changed.withColumn("outcome", F.lit("parsed")).union(reused).union(gone)

    def _parsed(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.parse(self.spark.createDataFrame([], "path string, line string"))
        # the listing gives plain paths, metadata percent-encoded ones
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        return self.parse(self.spark.read.text(paths).select(path.alias("path"), F.col("value").alias("line")))
