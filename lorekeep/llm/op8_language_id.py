"""Language identification: averaged hashed subword embeddings with a linear softmax.

Features are the 2- to 4-grams of the lower-cased UTF-8 bytes, digits and
punctuation read as spaces, hashed to ``BUCKETS`` rows of an embedding table.
A text is the average of its rows; a linear softmax over it gives the languages.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy.  For prediction both collapse into one table of logits for each bucket.

Training uses text and non-null lang of rows whose crc32(doc_id as text) mod 3
is not 1: every language, at most ``per_lang`` rows of each,
those of the smallest hash of doc_id, and ``max_rows`` in all (parameters of ``fit``).
Rows are counted by language first, so that only hashes low enough to be among the smallest
are ranked.  A fifth of them is held
back from training to calibrate: a temperature that minimises their log-loss, and the score
below which a prediction is rejected (``accepted`` false), set so that at most
``MAX_ERROR`` of what is accepted there is wrong.

Defined results: ``und`` with score 0 for a null or empty text or one without a
letter.  Without any row to learn from all are ``und``; so is an empty table's
nothing.  Ties: of equally likely languages the first by name; of equal hashes the
smaller doc_id is learned from.  Repeated rows have equal results; rows of a null
doc_id are predicted, not held out and not learned from.  Texts are read
whole, about 1 MB (one text at least) at a time.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import arrow_map, slices

BUCKETS, DIM = 1 << 15, 12
PER_LANG, MAX_ROWS = 400, 4000
#: More languages than this are an error, as their names and weights are held whole.
MAX_LANGS = 100_000
MAX_ERROR = 0.005
_TO = np.arange(256, dtype=np.uint8)
_TO[:128] = [ord(c.lower()) if (c := chr(i)).isalpha() else 32 for i in range(128)]
_MULT = np.uint32(2654435761)


def grams(raw: np.ndarray) -> np.ndarray:
    """Bucket of the 2-, 3- and 4-gram that ends at each byte (three rows; grams of two spaces and more go to bucket 0)."""
    b = _TO[raw].astype(np.uint32)
    out = np.zeros((3, len(b)), dtype=np.uint16)
    acc = b.copy()
    for i in range(1, 4):
        acc[i:] = b[i:] | (b[:-i] << np.uint32(8 * i)) if i == 1 else acc[i:] | (b[:-i] << np.uint32(8 * i))
        out[i - 1, i:] = (((acc[i:] ^ np.uint32(i * 0x9E3779B9 & 0xFFFFFFFF)) * _MULT) >> np.uint32(17)).astype(np.uint16)
    blank = np.zeros(len(b), dtype=bool)
    blank[1:] = (b[1:] == 32) & (b[:-1] == 32)
    out[:, blank] = 0
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a lower-cased text and their shares."""
    c = np.bincount(grams(np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)).ravel(), minlength=BUCKETS)
    c[0] = 0
    at = np.flatnonzero(c)
    return at.astype(np.int32), (c[at] / max(1, c.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_lang: int, epochs: int = 12, rate: float = 4.0, batch: int = 32) -> np.ndarray:
    """Logits of each bucket (BUCKETS x languages) by stochastic gradient descent on embeddings and softmax."""
    rng = np.random.default_rng(8)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, n_lang), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            at = np.concatenate([rows[i][0] for i in part])
            share = np.concatenate([rows[i][1] for i in part])
            runs = np.array([len(rows[i][0]) for i in part])
            starts = np.cumsum(runs) - runs
            mean = np.add.reduceat(emb[at] * share[:, None], starts, axis=0)
            z = mean @ out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = p / len(part)
            back = g @ out.T
            out -= step * (mean.T @ g)
            np.add.at(emb, at, -step * share[:, None] * np.repeat(back, runs, axis=0) * 16)
    return emb @ out


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of the least log-loss, and the score from which on few accepted predictions are wrong."""

    def loss(t: float) -> float:
        s = z * t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    t = min(np.geomspace(0.1, 30, 60), key=loss)
    s = np.exp(z * t - (z * t).max(axis=1, keepdims=True))
    p = s / s.sum(axis=1, keepdims=True)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order])
    fine = np.flatnonzero(wrong <= MAX_ERROR * np.arange(1, len(y) + 1))
    return float(t), float(score[order[fine[-1]]]) if len(fine) else 1.0


def _held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> dict | None:
    """The model, from bounded samples of each language: no language goes without a row."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).where(F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("doc_id")
    sized = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sized) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang: not a column of languages")
    max_rows = max(max_rows, 2 * len(sized))
    # the smallest per_lang of n hashes lie below four times their share of the range, but for a chance of nothing
    low = [(r.lang, 2**63 - 1 if r.n <= 4 * per_lang else int(-(2**63) + 4 * per_lang / r.n * 2**64)) for r in sized]
    below = docs.sparkSession.createDataFrame(low, "__lang string, __below long")
    # ids first, so that texts don't go through the window
    near = rows.select(F.col("doc_id").alias("__id"), "lang").join(F.broadcast(below), F.col("lang") == F.col("__lang")).where(F.xxhash64("__id") <= F.col("__below"))
    ids = near.withColumn("__r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("__id"), "__id")))
    ids = ids.where(F.col("__r") <= per_lang).orderBy("__r", "lang").limit(max_rows).select("__id").distinct()
    chosen = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi").select("doc_id", F.lower("text").alias("text"), "lang", h.alias("h"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        made = [counts(t) for t in batch.column("text").to_pylist()]
        yield {"h": batch.column("h"), "lang": batch.column("lang"), "at": [a.astype("<i4").tobytes() for a, _ in made], "share": [s.tobytes() for _, s in made]}

    got = sorted(arrow_map(chosen, run, "h bigint, lang string, at binary, share binary").limit(max_rows).collect())
    langs = sorted({r.lang for r in got})
    if not langs:
        return None
    data = [(np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["share"], dtype=np.float32)) for r in got]
    y = np.array([langs.index(r.lang) for r in got])
    back = np.arange(len(got)) % 5 == 4
    keep = np.flatnonzero(~back)
    table = train([data[i] for i in keep], y[keep], len(langs))
    check = np.flatnonzero(back) if back.any() else keep
    z = np.array([(table[data[i][0]] * data[i][1][:, None]).sum(axis=0) for i in check])
    t, accept = calibrate(z, y[check])
    table[0] = 0
    return {"langs": langs, "table": table * t, "accept": accept}


def predict(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language and its score for each (lower-cased) text of an Arrow array."""
    parts = [(" " + (t or "") + " ").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    g = grams(np.frombuffer(b"".join(parts), dtype=np.uint8))
    for i in range(3):  # grams that reach back into the text before
        for j in range(i + 1):  # an empty text has two bytes, of which the last text's may end the array
            at = starts + j
            g[i, at[at < g.shape[1]]] = 0
    table = np.ascontiguousarray(model["table"].astype(np.float32))
    used = np.add.reduceat((g != 0).sum(axis=0), starts)
    z = np.zeros((len(parts), len(model["langs"])))
    for lang in range(z.shape[1]):
        column = np.ascontiguousarray(table[:, lang])
        total = column[g[0]]
        total += column[g[1]]
        total += column[g[2]]
        z[:, lang] = np.add.reduceat(total, starts, dtype=np.float64)
    z /= np.maximum(used, 1)[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or fit(docs)
    rows = docs.select("doc_id", _held_out().alias("held_out"), F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        m = shared.value
        for part in slices(batch, "text", 1 << 20):
            best, score = predict(m, part.column("text"))
            letters = part.column("letters").to_numpy(zero_copy_only=False)
            score = np.where(letters, score, 0.0)
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": [m["langs"][b] if ok else "und" for b, ok in zip(best, letters, strict=True)], "score": score, "accepted": letters & (score >= m["accept"])}

    return arrow_map(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
