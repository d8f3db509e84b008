import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import records as R
from lorekeep.operators import index as IX
from lorekeep.operators import retrieval as RT
from lorekeep.operators import usage as U
from lorekeep.sources import jsonl
from lorekeep.streaming.events import adoption_once, daily_activity


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_status_and_kinds(spark):
    df = spark.createDataFrame([(" Partial-Current ", "note"), (None, "pitfall"), ("archived", "nothing"), ("ACTIVE", None)], "s string, k string")
    got = df.select(R.status_value(F.col("s")), R.is_current(F.col("s"), F.lit("")), R.legacy_kind(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("partial_current", True, "requirement"), ("", True, "pitfall"), ("archived", False, None), ("active", True, None)]


def test_hash_fraction(spark):
    import hashlib

    got = spark.createDataFrame([("a",), ("task-7",)], "t string").select("t", R.hash_fraction(F.col("t"))).collect()
    for t, x in got:
        assert x == int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") / float(1 << 64)


def test_redact_query(spark):
    text = "api_key = abc123, at 192.168.1.20 with sk-" + "x" * 12
    assert spark.range(1).select(R.redact_query(F.lit(text))).first()[0] == "api_key=<redacted>, at <private-ip> with <redacted-token>"


def test_clipped(spark):
    got = spark.range(1).select(R.clipped(F.lit("a  b　c" + "d" * 20), 10), R.clipped(F.lit(" x "), 5)).first()
    assert got[0] == "a b cdd..." and got[1] == "x"


@pytest.fixture
def corpus(tmp_path):
    def put(path, *lines):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("\n".join(lines))

    put("parent/child/main/kb.jsonl", json.dumps({"id": "1", "title": "A"}), "", "{broken", "[1, 2]")
    put("solo/kb.jsonl", json.dumps({"id": "2", "kind": "map", "tags": ["x"]}))
    put("bad/main/kb.jsonl", "<<<<<<< ours", json.dumps({"id": "3"}))
    put("my repo+x/a b/kb.jsonl", "========", json.dumps({"id": "5"}))
    put("worse/main/kb.jsonl", json.dumps({"id": "6"}), "=======  ")
    put("solo/other.jsonl", json.dumps({"id": "4"}))
    return str(tmp_path)


def test_read_records(spark, corpus):
    got = rows(jsonl.read_records(spark, corpus).select("bucket_repo", "bucket_branch", "id"))
    assert got == [("my repo+x", "a b", "5"), ("parent/child", "main", "1"), ("solo", "no-git", "2")]


def test_strict_report(spark, corpus):
    got = rows(jsonl.strict_parse_report(jsonl.read_lines(spark, corpus)).select("line"))
    assert got == [("<<<<<<< ours",), ("=======  ",), ("========",), ("[1, 2]",), ("{broken",)]


def test_write_and_archive(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01-05", "r", "b"), ("2", "2024-02-01", "r", "c")], "id string, ts string, repo string, branch string")
    jsonl.write_records(df, str(tmp_path / "w"))
    jsonl.write_records(df.where("branch = 'c'").withColumn("id", F.lit("9")), str(tmp_path / "w"))
    assert rows(spark.read.json(str(tmp_path / "w")).select("id", "branch")) == [("1", "b"), ("9", "c")]
    jsonl.write_archive(df, str(tmp_path / "a"))
    assert rows(spark.read.json(str(tmp_path / "a")).select("id", F.date_format("month", "yyyy-MM"))) == [("1", "2024-01"), ("2", "2024-02")]


def test_adoption_stats(spark):
    ev = [("e1", "A", "fix", "2024-01-02", 1), ("e1", "A", "fix", "2024-01-09", 2), ("e2", "A", "locate", "2024-01-08", 3), ("e3", "A", "write", "2024-01-03", 4), (" ", "A", "fix", "2024-01-03", 5), ("e4", "A", "guess", "2024-01-03", 6), ("e5", "B", "locate", "2024-01-01", 7)]
    stats = U.adoption_stats(spark.createDataFrame(ev, "event_id string, entry_id string, effect string, ts string, seq bigint"))
    assert rows(stats.select("entry_id", "n_events", "heated_count", "last_used_ts")) == [("A", 3, 2, "2024-01-03"), ("B", 1, 0, None)]
    rec = spark.createDataFrame([("A", 3), ("C", -1), ("D", None)], "id string, used_count bigint")
    assert rows(U.heat_join(rec, stats).select("id", "effective_usage")) == [("A", 5), ("C", 0), ("D", 0)]


def test_effect_precedence(spark):
    df = spark.createDataFrame([(1, "x", "locate"), (1, "x", "write"), (1, "x", "fix"), (1, "y", "locate"), (1, "y", "none")], "closeout_id int, entry_id string, effect string")
    assert rows(U.effect_precedence(df)) == [(1, "x", "write"), (1, "y", "locate")]


def test_index(spark):
    rec = spark.createDataFrame([("1", "r", "b", ["X ", "x", "", "y"], ["t"]), ("2", "r", "c", ["x"], ["t", "u"])], "id string, repo string, branch string, keywords array<string>, tags array<string>")
    p = IX.postings(rec)
    assert rows(IX.inverted_index(p)) == [("x", 2, 2), ("y", 1, 1)]
    counts = IX.search_counts(spark.createDataFrame([("X z", "1"), ("x", "2")], "query string, ts string"))
    merged = IX.with_searches(IX.inverted_index(p), counts)
    assert rows(merged) == [("x", 2, 2, 2, "2"), ("y", 1, 1, 0, None), ("z", 0, 0, 1, "1")]
    assert rows(IX.aggregation_candidates(merged, 2, 2, 2).select("keyword")) == [("x",)]
    assert ("x", "t", 2, 1, True) in rows(IX.tag_distribution(rec, p))


def test_index_lists(spark):
    """The index holds every entry and bucket of a keyword, not only how many there are; an id in two buckets is one entry."""
    rec = spark.createDataFrame([("1", "r", "b", ["X ", "x", "", "y"]), ("2", "r", "c", ["x"]), ("2", "r", "d", ["x"])], "id string, repo string, branch string, keywords array<string>")
    assert rows(IX.index_lists(IX.postings(rec))) == [("x", "1", "r/b", 2, 3), ("x", "2", "r/c", 2, 3), ("x", "2", "r/d", 2, 3), ("y", "1", "r/b", 1, 1)]


def test_ranked_search(spark):
    rec = spark.createDataFrame([("1", "red fox", ["fox"], "the red fox", "active", 0, "1"), ("2", "Other", ["z"], "a fox", "Archived", 0, "1"), ("3", "none", [], "nothing", "", 0, "1"), ("4", None, None, None, None, None, None)], "id string, title string, tags array<string>, story string, status string, used_count bigint, ts string")
    q = spark.createDataFrame([(7, "red fox", ["red fox", "red", "fox"])], "query_id int, query string, terms array<string>")
    got = RT.relevance(RT.term_hits(rec, ["red fox", "red", "fox"]), q, rec)
    # title exact 30 + three terms 18 + tag 4 + story phrase 4 + three terms 3; and one term less the status
    assert rows(got) == [(7, "1", 59), (7, "2", -11)]
    assert [r.id for r in RT.top_k(got, rec, 1).collect()] == ["1"]


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([("e1", "a", "2024-01-01 10:00:00"), ("e1", "a", "2024-01-01 10:05:00"), ("e2", "b", "2024-01-03 01:00:00"), ("e3", "b", "2024-01-09 01:00:00")], "event_id string, event_type string, t string").select("event_id", "event_type", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode):
        q = out.writeStream.format("memory").queryName("s").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / mode)).start()
        q.awaitTermination()
        return rows(spark.table("s"))

    assert run(daily_activity(stream), "complete") == rows(daily_activity(df))
    assert [r[0] for r in run(adoption_once(stream), "append")] == ["e1", "e2", "e3"]
