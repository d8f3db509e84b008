"""Shared Spark helpers: materialised tables, pandas-free Arrow maps, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is set, in local mode only:
    on a cluster the executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The write's shuffle files are of no more use; Spark removes them once the
    driver's garbage is collected, which is asked for here (``tidy``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that later written tables have replaced."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, beside which no column's name can clash."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns a record batch into dicts of equally long columns."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``budget`` bytes of ``column`` (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= budget:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def by_key(df: DataFrame, key: str, **made: Column) -> DataFrame:
    """``key`` and the aggregates of its rows, to be joined with those rows.

    Grouped by the key in a struct: what is dealt by that is not dealt by the key,
    so a join by the key shuffles both sides, and Spark can split a hot key's rows.
    """
    return df.groupBy(F.struct(key).alias("__key")).agg(*(c.alias(name) for name, c in made.items())).select(f"__key.{key}", *made)


def stars(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components, as a written table: (node, component) for every node that is not the smallest of its component.

    Alternates large-star and small-star steps on the edge list, so the work of a
    round is a few shuffles by node whatever the degree.  Minima are aggregated
    before the shuffle, and both sides of the joins by node are plain shuffles,
    of which Spark splits a hub's partition.  Rounds grow with the logarithm of
    the diameter; the last one is known by its edges, which are stars.  Each
    round writes one table and deletes the one before.  ``edges`` is read several
    times in the first round: give a table that is cheap to read.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b")
    written = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u hang on the smallest neighbour of u
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = by_key(both, "a", low=F.min("b"))
        larger = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        # small star: smaller neighbours and u itself hang on the smallest of them
        low = by_key(larger, "a", low=F.min("b"))
        hung = larger.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("s"))
        e = materialise(hung.select(F.col("s.a").alias("a"), F.col("s.low").alias("b")).where("a <> b").distinct(), "edges", False)
        if written is not None:
            discard(written)
        written = e
        # in a star no node hangs on two, or hangs on one while another hangs on it
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("below")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("below").alias("below")).where("up > 1 or up + below > 1").agg(F.count(F.lit(1))).first()[0] == 0:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out.written = e.written
    return out


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component) for every node with an edge; the smallest id is the component."""
    hung = stars(edges, src, dst, max_rounds)
    return hung.union(hung.select("component", "component").distinct())
