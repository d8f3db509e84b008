"""Document fingerprints by Order MinHash.

Every window of ``K`` code points is numbered by its occurrence, so that repeats
differ.  A hash of (k-mer, occurrence) deals them to ``SKETCHES`` buckets; each
bucket selects its two smallest, puts them back into text order and hashes the
pair.  The fingerprint is the 64 pair hashes of 16 bits in hex (an empty bucket
is 0000).  Moving or editing text changes which k-mers are smallest and also
their order, so likeness follows edit distance rather than content alone.
Likeness is the share of equal pair hashes among buckets used by either text.

The edited text of a document needs the next one (descending doc_id), so
documents are dealt to ranges of doc_id by sampled quantiles and one shuffle
brings neighbours together; the first document of each range is sent to the
range before it as well, and nothing else is copied.

Defined results: a null text is empty.  A text shorter than ``K`` is one k-mer;
an empty text has fingerprint zeros and likeness 1 to an empty text, else 0.
Rows of equal doc_id follow in the order of the hash of their text, repeated rows one after the other; rows of
null doc_id come last, in that order too.  Very long texts are read whole, one at a time (a text takes some 20 bytes a code point).
An empty table gives an empty table.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import U64, kmers, mix


K, SKETCHES = 8, 64
_BITS = SKETCHES.bit_length() - 1


def sketch(text: str) -> np.ndarray:
    """Pair hashes of the buckets; 0 for an empty one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = kmers(codes, K)
    n = len(h)
    out = np.zeros(SKETCHES, dtype=np.uint16)
    if not n:
        return out
    # occurrence numbers: order by hash, then position
    if n < 1 << 20:
        s = np.sort((h & ~U64((1 << 20) - 1)) | np.arange(n, dtype=U64))
        at, key = (s & U64((1 << 20) - 1)).astype(np.int64), s >> U64(20)
    else:
        at = np.argsort(h, kind="stable")
        key = h[at] >> U64(20)
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    v = mix(key * U64(0x9E3779B97F4A7C15) + number.astype(U64))
    bucket = v >> U64(64 - _BITS)
    # only small values can be among the two smallest of a full bucket
    limit = 12 * SKETCHES / n
    if limit < 1:
        small = np.flatnonzero((v << U64(_BITS)) < U64(int(limit * 2.0**63) * 2))
        if np.bincount(bucket[small].astype(np.int64), minlength=SKETCHES).min() >= 2:
            v, bucket, at = v[small], bucket[small], at[small]
    order = np.argsort(v)
    v, bucket, at = v[order], bucket[order].astype(np.int64), at[order]
    one = np.flatnonzero(np.diff(bucket, prepend=-1))
    b = bucket[one]
    two = np.minimum(one + 1, len(v) - 1)
    paired = (bucket[two] == b) & (two > one)
    swap = paired & (at[two] < at[one])
    x, y = np.where(swap, v[two], v[one]), np.where(swap, v[one], v[two])
    pair = np.where(paired, mix(x + mix(y)), mix(x))
    out[b] = (pair >> U64(48)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != 0) | (b != 0)
    n = int(used.sum())
    return float((used & (a == b)).sum() / n) if n else 1.0


def shown(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranged(docs: DataFrame) -> DataFrame:
    """doc_id, text, __h, __range, __halo: documents in ranges of descending doc_id, each with the next range's first."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # the number of cuts above doc_id; null ids follow, in ranges of the hash of their text
    docs = docs.withColumn("__h", F.xxhash64("text"))
    found = F.array_size(F.filter(F.lit(cuts), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    null_range = F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * n)
    where = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + null_range).otherwise(found)
    docs = docs.withColumn("__range", where.cast("int"))
    # bounded: one row for each range
    first = docs.groupBy("__range").agg(F.min(F.struct((-F.col("doc_id")).alias("i"), F.col("__h").alias("h"))).alias("f"))
    heads = sorted((r[0], r[1], r[2]) for r in first.select("__range", (-F.col("f.i")).alias("i"), "f.h").collect())
    if not heads:
        return docs.withColumn("__halo", F.lit(False))
    to = [heads[-1][0], *(h[0] for h in heads[:-1])]  # the first of all follows the last
    halo = spark.createDataFrame([(h[1], h[2], h[0], t) for h, t in zip(heads, to, strict=True)], "__id bigint, __hh bigint, __from int, __to int")
    copies = docs.join(F.broadcast(halo), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hh")) & (F.col("__range") == F.col("__from")))
    copies = copies.select("doc_id", "text", "__h", F.col("__to").alias("__range"), F.lit(True).alias("__halo"), "__from").dropDuplicates(["__from"]).drop("__from")
    return docs.withColumn("__halo", F.lit(False)).unionByName(copies)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _ranged(docs).repartition(n, "__range").sortWithinPartitions("__range", "__halo", F.col("doc_id").desc_nulls_last(), "__h", "text")
    target = T._parse_datatype_string(SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (range, doc_id, text, sketch) of the row before
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, where in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__range")), strict=True):
                own = sketch(text)
                if before is not None and before[0] == where:
                    _, i, t, s = before
                    e = edited(t, text)
                    se = sketch(e) if e != t else s
                    out.append((i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), shown(s), shown(se), likeness(s, se), likeness(s, own)))
                before = (where, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.select("doc_id", "text", "__range").mapInArrow(run, target)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
