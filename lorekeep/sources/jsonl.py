"""JSON-lines corpora: records under ``<repo>/<branch>/kb.jsonl``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, ts string, kind string, repo string, branch string, title string, story string, tags array<string>, aliases array<string>, trigger_terms array<string>, source_paths array<string>, key_files array<string>, status string, superseded_by string, used_count bigint, last_used_ts string, updated_ts string, _deleted boolean, _archived boolean"


def bucket_from_path(relative: Column) -> tuple[Column, Column]:
    """(repo, branch) of a file's path below the root: the last folder is the branch."""
    parts = F.filter(F.split(relative, "/"), lambda x: x != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    n = F.size(folders)
    repo = F.when(n >= 2, F.array_join(F.slice(folders, 1, F.greatest(n - 1, F.lit(0))), "/")).when(n == 1, F.element_at(folders, 1)).otherwise("unknown-repo")
    return repo, F.when(n >= 2, F.element_at(folders, -1)).otherwise("no-git")


def read_lines(spark: SparkSession, root: str, glob: str = "kb.jsonl") -> DataFrame:
    """path, relative, line for every line below ``root``; both paths decoded (Spark gives them percent-encoded)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    # a plus sign is itself in a path, but a space to url_decode
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return lines.select(path.alias("path"), F.substring_index(path, base, -1).alias("relative"), F.col("value").alias("line"))


def conflicted_files(lines: DataFrame) -> DataFrame:
    """Paths of files that hold merge-conflict markers."""
    marker = F.col("line").rlike(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?)\s*$")
    return lines.groupBy("path").agg(F.bool_or(marker).alias("bad")).where("bad").select("path")


def parse_records(lines: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """Records of all lines that are JSON objects; blank, broken and other lines are dropped.

    Files with conflict markers are rejected whole.  The raw line stays.
    """
    good = lines.join(conflicted_files(lines), "path", "left_anti").where(F.trim("line").startswith("{"))
    parsed = good.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    repo, branch = bucket_from_path(F.col("relative"))
    return parsed.where("r is not null and r._bad is null").select("path", F.col("line").alias("raw"), repo.alias("bucket_repo"), branch.alias("bucket_branch"), "r.*").drop("_bad")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    return parse_records(read_lines(spark, root))


def strict_parse_report(lines: DataFrame) -> DataFrame:
    """path, line: the non-blank lines that are not JSON objects."""
    ok = F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    return lines.where((F.trim("line") != "") & ~F.coalesce(ok, F.lit(False))).select("path", "line")


def write_records(records: DataFrame, root: str) -> None:
    """One folder for each bucket, as gzip-free JSON lines; touched buckets are replaced."""
    records.write.partitionBy("repo", "branch").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(root)


def write_archive(records: DataFrame, root: str) -> None:
    """Gzip JSON lines by month of ``ts``."""
    records.withColumn("month", F.substring("ts", 1, 7)).write.partitionBy("month").mode("append").option("compression", "gzip").json(root)
