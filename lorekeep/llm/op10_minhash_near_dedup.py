"""MinHash near-dedup with HyperMinHash registers.

Method: each text becomes a set of word-shingle hashes and a HyperMinHash
sketch.  Texts with equal sets form one class.  Class representatives are
banded on their compressed registers; colliding representatives are candidates,
kept when the collision-corrected estimate comes near the threshold, and
confirmed on their full sets.  Components of the confirmed links are the groups.

Work in a bucket stays bounded however large it grows, see ``lsh``.

Bands: 40 of 5 registers.  Two sets of similarity 0.8 share no band with a
probability of 1.2e-7; sets of up to ``tiny`` (64) shingles, where lent registers
make bands depend on each other, also meet by prefix keys, which miss nothing.

Defined results: null or blank texts have an empty set, are linked with nothing
and are kept.  Ties: of equal texts, as of a component, the smallest ``doc_id`` is
kept.  Each row counts: repeated rows have equal results, and rows of one
``doc_id`` with unlike texts are documents of their own that may lie in
different components.  A null ``doc_id`` takes no part: null component, kept.
Texts of any length are read whole, one at a time.  An empty table gives an
empty table.  Other columns are not read, whatever their names;
``drop_near_duplicates`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hyperminhash as hmh
from .hashing import shingles, words
from .lsh import groups
from .tables import arrow_map, by_key, materialise, packed, slices

BANDS, ROWS = 40, 5


def _set_of(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingles(words(text or "")[3], k))


def _sketches(docs: DataFrame, k: int, tiny: int, percent: int) -> DataFrame:
    """doc_id, n, set_hash, regs, prefix: the sketch of every document."""
    import hashlib

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            out: dict[str, list] = {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n": [], "set_hash": [], "regs": [], "prefix": []}
            for text in part.column("text"):
                s = _set_of(text.as_py(), k)
                out["n"].append(len(s))
                out["set_hash"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                out["regs"].append(hmh.registers(s).tobytes() if len(s) else None)
                need = len(s) - -(-percent * len(s) // 100) + 1
                out["prefix"].append(s[:need].view(np.int64).tolist() if 0 < len(s) <= tiny else None)
            yield out

    return arrow_map(docs.select("doc_id", "text", "text_hash"), run, "doc_id bigint, text_hash bigint, n bigint, set_hash binary, regs binary, prefix array<bigint>")


def _postings(reps: DataFrame) -> DataFrame:
    """(key, id, n): band keys of every representative, and prefix keys of tiny sets."""
    positions = hmh.band_positions(BANDS, ROWS)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, hmh.BUCKETS)
            yield {"key": hmh.band_keys(regs, positions).ravel(), "id": np.repeat(part.column("id").to_numpy(), BANDS), "n": np.repeat(part.column("n").to_numpy(), BANDS)}

    bands = arrow_map(reps.select("id", "n", "regs"), run, "key bigint, id bigint, n bigint")
    return bands.union(reps.select(F.explode("prefix").alias("key"), "id", "n"))


def _close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate leaves it possible (within five deviations) that a pair is linked."""
    low = percent / 100
    est, used = hmh.similarity(a, b, n_a, n_b)
    return (est >= low - 5 * np.sqrt(low * (1 - low) / np.maximum(used, 1))) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _sets(ids: DataFrame, where: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes): the full sets of some classes, made again from the texts of their first documents."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            yield {"id": part.column("id"), "hashes": [_set_of(t.as_py(), k).tobytes() for t in part.column("text")]}

    # the same plan at every size: the few ids are hashed beside the texts
    wanted = ids.join(where.hint("merge"), "id")
    rows = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"])
    return arrow_map(rows.select("id", "text"), run, "id bigint, hashes binary").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, small_bucket: int = 24, block: int = 500, tiny: int = 64) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (its own number), component_id, kept: one row for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    real = docs.where("doc_id is not null")
    sk = materialise(_sketches(real, shingle_words, tiny, percent), "sketches")
    place = F.struct("doc_id", "text_hash")
    classes = sk.where("n > 0").groupBy("set_hash").agg(F.min(place).alias("rep"))
    # a class has the smallest doc_id as its id; where unlike texts share one, the others get an id beyond all of those
    lead = classes.groupBy("rep.doc_id").agg(F.min("set_hash").alias("lead"))
    beyond = F.shiftright(F.xxhash64("set_hash").bitwiseAND(F.lit((1 << 63) - 1)), 1).bitwiseOR(F.lit(1 << 62))
    classes = classes.select("set_hash", "rep", "rep.doc_id").join(lead.hint("merge"), "doc_id").select("set_hash", "rep", F.when(F.col("set_hash") == F.col("lead"), F.col("doc_id")).otherwise(beyond).alias("id"))
    reps = sk.where("n > 0").select("doc_id", "text_hash", "n", "set_hash", "regs", "prefix").join(classes.hint("merge"), "set_hash").where("doc_id = rep.doc_id and text_hash = rep.text_hash")
    reps = materialise(reps.select("id", "n", "doc_id", "text_hash", "set_hash", "regs", "prefix").dropDuplicates(["id"]), "reps")

    positions = hmh.band_positions(BANDS, ROWS)
    where = reps.select("id", "doc_id", "text_hash")
    comps = groups(reps.select("id", "n", F.col("regs").alias("sig")), _postings(reps), lambda a, b, n_a, n_b: _close(a, b, n_a, n_b, percent), lambda regs: hmh.band_keys(regs, positions), lambda ids: _sets(ids, where, real, shingle_words), percent, small_bucket, block)

    of_class = reps.select("set_hash", "id", F.col("doc_id").alias("rep")).join(comps.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("set_hash", "rep", F.coalesce("component", "id").alias("component"))
    least = by_key(of_class, "component", component_id=F.min("rep"))
    of_class = of_class.join(least.hint("merge"), "component").select("set_hash", "component", "component_id")
    out = sk.select("doc_id", "text_hash", "n", "set_hash").join(of_class.hint("merge"), "set_hash", "left")
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lost = docs.where("doc_id is null")
    return out.union(arrow_map(lost, lambda batch: iter([{"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": [len(_set_of(t.as_py(), shingle_words)) for t in batch.column("text")], "component": [None] * batch.num_rows, "component_id": [None] * batch.num_rows, "kept": [True] * batch.num_rows}]), out.schema))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component; all columns stay.

    The row kept is that of the smallest doc_id, of the smallest hash of its text
    where it has several texts, and of the smallest hash of all columns where
    rows repeat with other values beside.  Rows without words or doc_id stay,
    each doc_id and text once where there is a doc_id.
    """
    rows = near_duplicates(docs, **options).where("kept and doc_id is not null")
    # of a component; a document without words stands for itself
    rows = rows.groupBy("doc_id", "component", F.when(F.col("n_shingles") == 0, F.col("text_hash")).alias("blank")).agg(F.min("text_hash").alias("text_hash")).select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash"))
    row = F.col("row")
    at = (row["doc_id"].cast("bigint") == F.col("__kept_id")) & (F.xxhash64(row["text"].cast("string")) == F.col("__kept_hash"))
    same = Window.partitionBy("__kept_id", "__kept_hash").orderBy(F.xxhash64(*(row[c] for c, kind in docs.dtypes if not kind.startswith("map"))))
    kept = packed(docs).join(rows.hint("shuffle_hash"), at).withColumn("__row", F.row_number().over(same)).where("__row = 1")
    return kept.select("row.*").union(docs.where("doc_id is null"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle_words=2).drop("text_hash", "component")


#: Exact links over full sets by a prefix filter on shingle order, then reachability.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
c AS (SELECT list_sort(sh) AS sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY 1),
p AS (
  SELECT rep, sh, len(sh) AS n, unnest(sh[1:len(sh) - CAST(ceil(0.8 * len(sh)) AS BIGINT) + 1]) AS t FROM c),
q AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM p a JOIN p b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (
  SELECT x, y FROM (SELECT q.x, q.y, len(list_intersect(a.sh, b.sh)) AS i, len(a.sh) + len(b.sh) AS t
    FROM q JOIN c a ON a.rep = q.x JOIN c b ON b.rep = q.y) WHERE 100 * i >= 80 * (t - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id,
  coalesce(m.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.sh = list_sort(s.sh) LEFT JOIN m ON m.node = c.rep
"""
