"""Stateful streams: the window of current briefs, and running heat of adopted records."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorekeep.functions.records import EFFECTS, HEAT_EFFECTS
from lorekeep.sources.shared import exists, removed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BRIEF = "doc_id bigint, ts string, id string"
BRIEF_STATE = "repo string, branch string, doc_id bigint, state string"
#: Fixed value: a bucket keeps 1 to 3 current briefs.
MOST_BRIEFS = 3


@contextmanager
def rocksdb(spark):
    """Streams that start inside keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class BriefWindow(StatefulProcessor):
    """Keeps the newest briefs of a bucket in list state; emits the state of each brief that comes or is demoted.

    A bucket whose briefs stop coming for ``idle_ms`` gives its state up by a timer, after which its briefs stay as last emitted.
    """

    def __init__(self, keep: int = MOST_BRIEFS, idle_ms: int | None = None) -> None:
        self.keep, self.idle_ms = max(1, min(MOST_BRIEFS, keep)), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getListState("current", BRIEF)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = {(ts, id_, -doc) for doc, ts, id_ in self.current.get()} if self.current.exists() else set()
        for part in rows:
            came = set(zip(part.ts, part.id, (-part.doc_id).tolist(), strict=True))
            kept = set(sorted(held | came, reverse=True)[: self.keep])
            rolled = sorted((held | came) - kept)
            new = sorted(kept - held)
            if rolled or new:
                yield pd.DataFrame({"repo": key[0], "branch": key[1], "doc_id": [-b[2] for b in rolled + new], "state": ["rolled_off_current"] * len(rolled) + ["current"] * len(new)})
            held = kept
        if held:
            self.current.put([(-doc, ts, id_) for ts, id_, doc in sorted(held)])
        if self.idle_ms is not None:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        self.current.clear()
        return iter([])

    def close(self) -> None:
        pass


def brief_states(briefs: DataFrame, keep: int = MOST_BRIEFS, idle_ms: int | None = None) -> DataFrame:
    """repo, branch, doc_id, state changes of a stream of briefs (doc_id, repo, branch, ts, id): the last change of a brief is its state.

    The state of a bucket is ``keep`` briefs, however many come.  Needs the RocksDB state store.  Rows without a bucket are not
    briefs of a window and give nothing.
    """
    rows = briefs.where("doc_id is not null and (repo is not null or branch is not null)").select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("repo", "branch", "ts", "id")))
    return rows.groupBy("repo", "branch").transformWithStateInPandas(BriefWindow(keep, idle_ms), BRIEF_STATE, "Append", "ProcessingTime" if idle_ms is not None else "None")


def heat_of(events: DataFrame) -> DataFrame:
    """entry_id, n_events, heated_count, last_used_ts of distinct adoption events."""
    ok = events.where(F.col("effect").isin(EFFECTS) & (F.trim("event_id") != "") & (F.trim("entry_id") != ""))
    heats = F.col("effect").isin(HEAT_EFFECTS)
    return ok.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(heats).alias("heated_count"), F.max(F.when(heats, F.col("ts"))).alias("last_used_ts"))


def merged_heat(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.unionByName(now).groupBy("entry_id").agg(*(F.sum(c).alias(c) for c in ("n_events", "heated_count")), F.max("last_used_ts").alias("last_used_ts"))


class HeatTable:
    """A keyed table of running heat, a version for each batch of a stream.

    Version n is version n - 1 merged with batch n, so a batch that runs again after a failure writes the same version again: nothing
    counts twice.  The version before the last stays until the next is whole.
    """

    def __init__(self, root: str) -> None:
        self.root = root

    def path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def merge(self, batch: DataFrame, version: int) -> None:
        spark, now = batch.sparkSession, heat_of(batch)
        if version and exists(spark, self.path(version - 1)):
            now = merged_heat(spark.read.parquet(self.path(version - 1)), now)
        now.write.mode("overwrite").parquet(self.path(version))
        if version > 1:
            removed(spark, self.path(version - 2))

    def last(self, spark) -> int | None:
        """The newest whole version."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
        whole = [int(n.split("=")[1]) for n in names if n.startswith("version=") and exists(spark, f"{self.root}/{n}/_SUCCESS")]
        return max(whole, default=None)


def running_heat(events: DataFrame, table: HeatTable, checkpoint: str, delay: str = "7 days"):
    """Start a stream of adoption events (with a timestamp ``logged_at``) that keeps ``table``; retries of an event within ``delay`` count once."""
    once = events.withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
