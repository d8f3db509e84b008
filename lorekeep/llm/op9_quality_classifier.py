"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 of low quality, 2 good.  A text's features are its distinct
hashed words (lower-cased, between white space and punctuation) plus its shape
in steps: the shares of capitals, symbols, exclamations and digits, of words
that repeat the one before, and its variety of words.  One weight vector ``w`` is shared by all grades;
ordered thresholds ``t1 < t2`` split the score:

    P(grade > j) = sigmoid(w . x - t_j)

which gives the expected grade and the tail probability P(grade = top).
The model is fitted in numpy by Adam on at most ``fit_rows`` labelled
documents, those of the smallest hash of doc_id (a documented bound; 8,000 by
default).  Scoring reads every document, in whole.

Selection keeps a document when its tail probability reaches ``keep_from``.
Defined results: a null or empty text has only the bias and scores as such;
labels without a document, of null grade, or of a null doc_id are not used; of
several labels for one document the lowest grade counts; without any label
every document is kept with a null score.  Ties and repeated rows: equal texts have equal
scores, a probability equal to ``keep_from`` keeps.  Texts are read whole, one at a time.  An empty table
gives an empty table.  Other columns are not read and stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import IS_NO_LETTER, U64, words
from .tables import packed

DIM = 1 << 18
FIT_ROWS = 8000
KEEP_FROM = 0.3
GRADES = 3
#: Classes of bytes whose shares describe a text's shape.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:!?'-()\""]] = 2
_CLASS[[ord("!"), ord("?")]] = 3
_CLASS[48:58] = 4


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text, ascending; 0 is the bias, below 64 are shape shares."""
    text = text or ""
    _, _, _, h = words(text, gaps=IS_NO_LETTER)
    distinct = np.unique(h)
    out = [np.zeros(1, dtype=np.int64)]
    if len(text):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        shares = np.bincount(_CLASS[raw], minlength=5)[1:] / len(raw)
        levels = np.minimum(8, np.floor(np.sqrt(shares) * 12)).astype(np.int64)
        again = (h[1:] == h[:-1]).mean() if len(h) > 1 else 0.0
        variety = len(distinct) / max(1, len(h)) ** 0.9  # long texts repeat more
        out.append(1 + 9 * np.arange(6) + np.concatenate([levels, [min(8, int(again * 12)), min(8, int(variety * 8))]]).astype(np.int64))
        out.append(np.unique(distinct % U64(DIM - 64)).astype(np.int64) + 64)
    return np.concatenate(out)


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 120, rate: float = 0.05, l2: float = 1e-4, min_z: float = 5.0) -> dict:
    """Weights and ordered thresholds from feature lists and grades, by full-batch Adam.

    Only words whose share of rows differs between higher and lower grades by
    ``min_z`` standard errors, at one threshold at least, get a weight.
    """
    lens = np.array([len(r) for r in rows])
    at, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    seen = np.bincount(inverse, minlength=len(at))
    z = np.zeros(len(at))
    for j in range(GRADES - 1):
        high = np.bincount(inverse, weights=np.repeat(grades > j, lens), minlength=len(at))
        n_high, n = (grades > j).sum(), len(rows)
        p = seen / n
        z = np.maximum(z, np.abs(high - n_high * p) / np.sqrt(np.maximum(n_high * (1 - n_high / n) * p * (1 - p), 1e-9)))
    scale = np.where((z >= min_z) & (seen >= 3) | (at < 64), 1.0, 0.0)
    # each grade weighs the same, but no grade more than eight times its share
    share = np.maximum(np.bincount(grades, minlength=GRADES) / len(grades), 1e-9)
    weight = np.minimum(8, 1 / (GRADES * share))[grades]
    weight = weight / weight.sum()
    w = np.zeros(len(at))
    gap = np.array([-1.0, 0.0])  # the first threshold, then logs of the steps
    m = [np.zeros_like(w), np.zeros_like(gap)]
    v = [np.zeros_like(w), np.zeros_like(gap)]
    for step in range(1, rounds + 1):
        z = np.add.reduceat((w * scale)[inverse], starts)
        cuts = np.array([gap[0], gap[0] + np.exp(gap[1])])
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -40, 40)))
        # cumulative-link likelihood of the grade's interval
        upper = np.concatenate([np.ones((len(z), 1)), p], axis=1)[np.arange(len(z)), grades]
        lower = np.concatenate([p, np.zeros((len(z), 1))], axis=1)[np.arange(len(z)), grades]
        inside = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        dz = -weight * (du - dl) / inside
        g_w = np.bincount(inverse, weights=np.repeat(dz, lens), minlength=len(at)) * scale + l2 * w
        dc = np.zeros(2)
        for j in range(2):
            is_upper, is_lower = grades == j + 1, grades == j
            dc[j] = (weight * (is_upper * du - is_lower * dl) / inside).sum()
        g_gap = np.array([dc.sum(), dc[1] * np.exp(gap[1])])
        for x, g, i in ((w, g_w, 0), (gap, g_gap, 1)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(DIM, dtype=np.float32)
    full[at] = w * scale
    return {"w": full, "cuts": (float(gap[0]), float(gap[0] + np.exp(gap[1])))}


def score(model: dict, texts: pd.Series) -> pd.DataFrame:
    z = np.array([model["w"][features(t)].sum() for t in texts], dtype=np.float64)
    p = 1 / (1 + np.exp(-np.clip(z[:, None] - np.array(model["cuts"]), -40, 40)))
    return pd.DataFrame({"expected_grade": p.sum(axis=1), "p_top": p[:, -1], "p_not_lowest": p[:, 0]})


def graded(labels: DataFrame) -> DataFrame:
    """(label_id, grade) from the columns doc_id, quality, toxic."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").alias("label_id"), grade.alias("grade")).where("grade is not null and label_id is not null").groupBy("label_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """The model, or None without labelled documents.  Features of at most ``fit_rows`` rows reach the driver."""
    chosen = graded(labels).orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "grade": f.grade, "slots": [np.sort(features(t)).astype("<i4").tobytes() for t in f.text]})

    got = rows.select("doc_id", "grade", "text").mapInPandas(run, "doc_id bigint, grade int, slots binary").limit(fit_rows).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "grade", "slots"])
    return fit([np.frombuffer(b, dtype="<i4") for b in got.slots], got.grade.to_numpy().astype(int))


def _scores(model: dict) -> Column:
    @F.pandas_udf("expected_grade double, p_top double, p_not_lowest double")
    def run(text: pd.Series) -> pd.DataFrame:
        return score(model, text)

    return run


def graded_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with a struct column ``__quality`` (expected_grade, p_top, p_not_lowest, kept) in place of one of that name."""
    docs = docs.drop("__quality")
    model = train(docs, labels, fit_rows)
    if model is None:
        return docs.withColumn("__quality", F.lit(None).cast("struct<expected_grade:double,p_top:double,p_not_lowest:double>")).withColumn("__quality", F.struct("__quality.*", F.lit(True).alias("kept")))
    scored = docs.withColumn("__quality", _scores(model)(F.col("text").cast("string")))
    return scored.withColumn("__quality", F.struct("__quality.*", (F.col("__quality.p_top") >= keep_from).alias("kept")))


def select_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` that the classifier keeps (all, without labelled documents); all columns stay, whatever their names."""
    model = train(docs, labels, fit_rows)
    if model is None:
        return docs
    top = _scores(model)(F.col("row.text").cast("string"))["p_top"]
    return packed(docs).withColumn("p_top", top).where(F.col("p_top") >= keep_from).select("row.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the whole table with expected grade, tail probability and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return graded_quality(docs.select("doc_id", "text"), labels).select("doc_id", F.col("__quality.expected_grade").alias("expected_grade"), F.col("__quality.p_top").alias("p_good"), F.col("__quality.kept").alias("kept"))
