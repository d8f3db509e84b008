"""SentencePiece encoding and decoding: distinct sampled segmentations of each text.

A text's segmentations are weighed by exp(theta * sum of piece scores).  The
``k`` samples are a Gumbel top-k without replacement: a perturbed best-first
(A-star) search over the lattice.  The space of segmentations is one subspace
with the largest perturbed score G; taking the best subspace emits the
segmentation that reaches its G and splits the rest of the subspace at every
unit of the text into those that agree before the unit and differ in it.  Their
own largest scores are Gumbel variables truncated at G.  With the (k+1)-th
score as threshold, a sample of log-probability p is included with probability
1 - exp(-exp(p - threshold)); its logarithm is returned.

Random numbers are hashes of (row key, round, unit, step): a row's samples
depend on its doc_id and text alone.

Decoding joins the pieces, turns word marks into spaces, takes the added first
space away, and must give the text back (with U+2581 read as a space, as the
tokenizer reads it).

Defined results: a null or empty text has one empty segmentation, of
log-probability 0 and log-inclusion 0.  A text with fewer than ``k`` segmentations
returns all it has; what has less than 1e-13 of its
place's probability counts as none (double precision).  A null doc_id has the key 0.
Ties are left to the random numbers, which do not repeat within a row.  Rows equal in doc_id and text have equal samples.
Texts are read whole, about 0.5 MB (one text at least) at a time; a long text without spaces is one
unit and takes a numpy step for each of its characters.  An empty table gives an empty table.  Other
columns are not read, whatever their names, but for those of ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import U64, mix
from .lattice import SPACE, Sampler, Vocabulary, build, distinct, sampler, units
from .tables import arrow_map, slices

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
THETA = 1 / 2000


_ROUND, _UNIT, _STEP = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def uniform(seed: np.ndarray, number: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) from the seed of a row and round, the unit and the step."""
    x = mix(seed + number.astype(U64) * _UNIT + U64(step * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


_ALL = 0xFFFFFFFFFFFFFFFF


def _one(seed: int, number: int, step: int) -> float:
    """``uniform`` of single numbers."""
    x = seed + number * int(_UNIT) + step * int(_STEP) & _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return ((x ^ x >> 31) >> 11) / (1 << 53) + 0.5 / (1 << 53)


def _seeds(keys: np.ndarray, round_: int) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(U64) + U64(0x53504D)) + U64(round_ * int(_ROUND) & 0xFFFFFFFFFFFFFFFF))


def _gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def _truncated(log_mass: float, bound: float, u: float) -> float:
    """Largest perturbed score of a subspace, given that it is below ``bound``."""
    if log_mass == -math.inf:
        return -math.inf
    a, b = -bound, -(log_mass + _gumbel(u))
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


def draw(s: Sampler, which: np.ndarray, seed: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segmentation for each unit instance: its log-probability, and edges (instance by instance, last piece first) with their counts."""
    turn = np.argsort(which, kind="stable")  # equal units side by side, for the caches
    w, seed, number = which[turn], seed[turn], number[turn]
    n = np.arange(len(s.lat.heads) - 1)
    node, root = (s.lat.heads[1:] + n)[w], (s.lat.heads[:-1] + n)[w]
    log_p = np.zeros(len(w))
    live = np.arange(len(w))
    steps, owners = [], []
    while len(live):
        u = uniform(seed, number, len(steps))
        edge = s.lo[node]
        on = np.flatnonzero(s.upto[edge] < u)
        while len(on):
            edge[on] += 1
            on = on[s.upto[edge[on]] < u[on]]
        log_p[live] += s.log_p[edge]
        steps.append(edge)
        owners.append(turn[live])
        node = s.start[edge]
        more = np.flatnonzero(node != root)
        live, node, root, seed, number = live[more], node[more], root[more], seed[more], number[more]
    counts = np.zeros(len(which), dtype=np.int64)
    for o in owners:
        counts[o] += 1
    at = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), dtype=np.int64)
    for i, (o, e) in enumerate(zip(owners, steps, strict=True)):
        edges[at[o] + i] = e
    out = np.empty(len(which))
    out[turn] = log_p
    return out, edges, counts


def redraw(s: Sampler, unit: int, taken: list[tuple[int, ...]], seed: int, number: int) -> tuple[tuple[int, ...], float]:
    """One segmentation (edges, last first) of a unit that is not among ``taken``, by its conditional distribution."""
    node, root = int(s.lat.heads[unit + 1]) + unit, int(s.lat.heads[unit]) + unit
    path: list[int] = []
    log_p = 0.0
    live = list(taken)
    while node != root:
        lo, hi = int(s.lo[node]), int(s.lo[node + 1])
        mass = [math.exp(x) for x in s.log_p[lo:hi].tolist()]
        depth = len(path)
        for t in live:  # what is left of the mass behind each edge
            mass[t[depth] - lo] -= math.exp(sum(s.log_p[list(t[depth:])]))
        mass = [max(x, 0.0) for x in mass]
        goal = _one(seed, number, (1 << 22) + depth) * sum(mass)
        e = lo
        for e, x in enumerate(mass, lo):
            goal -= x
            if goal < 0:
                break
        path.append(e)
        log_p += float(s.log_p[e])
        live = [t for t in live if t[depth] == e]
        node = int(s.start[e])
    return tuple(path), log_p


class Decoder:
    """From piece ids to the text, with a vocabulary."""

    def __init__(self, vocab: Vocabulary) -> None:
        raw = {int(i): p.replace(bytes([SPACE]), b" ") for i, p in zip(vocab.ids, vocab.pieces, strict=True)}
        raw |= {int(i): bytes([x]) for x, i in enumerate(vocab.byte_ids) if i >= 0}
        table = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.size = np.array([len(p) for p in table])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        """Pieces joined, word marks as spaces, without the added first space."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at].tobytes()[1:].decode("utf-8", "surrogatepass")


class Encoder:
    """Encodes batches of texts with a vocabulary."""

    def __init__(self, vocab: Vocabulary, k: int, theta: float) -> None:
        self.vocab, self.k, self.theta = vocab, k, theta

    def ids(self, s: Sampler, edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Piece ids in text order of edges stored last piece first in each unit."""
        ends = np.cumsum(counts)
        places = edges[np.repeat(2 * ends - counts - 1, counts) - np.arange(len(edges))]
        out = s.ids[places]
        lone = np.flatnonzero(out < 0)
        if not len(lone):
            return out
        e = s.order[places]
        # a character without a piece becomes its bytes
        size = np.where(out < 0, s.lat.z[e] - s.lat.a[e], 1)
        out = np.repeat(out, size)
        at = np.flatnonzero(out < 0)
        raw = np.repeat(s.lat.a[e[lone]] - np.cumsum(size[lone]) + size[lone], size[lone]) + np.arange(len(at))
        out[at] = self.vocab.byte_ids[s.lat.bytes[raw]]
        return out

    def __call__(self, keys: np.ndarray, texts: list[str | None]) -> Iterator[list[tuple[np.ndarray, float, float]]]:
        """For each text its samples: ids, log-probability, log of the inclusion probability."""
        b, starts, ends, owner = units(texts)
        if not len(starts):
            yield from ([(np.zeros(0, dtype=np.int32), 0.0, 0.0)] for _ in texts)
            return
        _, first, which = distinct(b, starts, ends)
        s = sampler(build(self.vocab, b, starts[first], ends[first]), self.theta)
        s.ids = np.append(self.vocab.ids, -1).astype(np.int32)[s.lat.piece[s.order]]
        doc = np.repeat(np.arange(len(texts)), np.diff(owner))
        number = np.arange(len(starts)) - owner[doc]
        seeds = [_seeds(keys, r) for r in range(self.k)]
        rounds = []
        for r in range(self.k):
            log_p, edges, counts = draw(s, which, seeds[r][doc], number)
            rounds.append((log_p, edges, counts, np.concatenate([[0], np.cumsum(counts)])))
        for d in range(len(texts)):
            lo, hi = owner[d], owner[d + 1]
            if lo == hi:
                yield [(np.zeros(0, dtype=np.int32), 0.0, 0.0)]
            else:
                yield self.search(s, which[lo:hi], [(p[lo:hi], e[at[lo] : at[hi]], c[lo:hi]) for p, e, c, at in rounds], [int(x[d]) for x in seeds])

    def search(self, s: Sampler, which: np.ndarray, rounds: list, seeds: list[int]) -> list:
        n = len(which)

        def widen(path: Path, bound: float) -> None:
            """Split the subspace behind the path's known part: those that leave the path at one of the next units, and the rest."""
            start = path.known
            stop = min(n, start + _WIDTH)
            log_p = path.log_p[start:stop]
            mass = []
            for x in log_p.tolist():
                path.prefix.append(path.before)
                mass.append(path.before + _log_rest(x))
                path.before += x
            path.known = stop
            mass.append(path.before + _log_rest(float(path.log_p[stop:].sum())) if stop < n else -math.inf)
            g = [_truncated(m, bound, _one(path.seed, start + i, 1 << 20)) for i, m in enumerate(mass)]
            if path.g:  # the split subspace was taken: one part has its score, the others less
                top = max(mass)
                weight = [math.exp(m - top) for m in mass]
                goal, chosen = _one(path.seed, start, 1 << 21) * sum(weight), 0
                while chosen < len(weight) - 1 and goal >= weight[chosen]:
                    goal -= weight[chosen]
                    chosen += 1
                g[chosen] = bound
            path.g += g[:-1]
            path.behind = g[-1]

        top = _gumbel(_one(seeds[0], 0, 1 << 19))
        log_p, edges, counts = rounds[0]
        paths = [Path(log_p, edges, counts, 0, 0.0, seeds[0])]
        widen(paths[0], top)
        for r in range(1, self.k + 1):
            while True:
                path = max(paths, key=lambda p: p.best())
                bound = path.best()
                if bound == -math.inf or max(path.g, default=-math.inf) >= path.behind:
                    break
                widen(path, bound)
            if r == self.k or bound == -math.inf:
                break
            i = max(range(len(path.g)), key=path.g.__getitem__)
            unit = path.first + i
            lo = int(path.counts[:unit].sum())
            hi = lo + int(path.counts[unit])
            taken = path.taken.setdefault(unit, [tuple(path.edges[lo:hi].tolist())])
            way, p = redraw(s, int(which[unit]), taken, seeds[r], unit)
            f_log_p, f_edges, f_counts = rounds[r]
            new = Path(
                np.concatenate([path.log_p[:unit], [p], f_log_p[unit + 1 :]]),
                np.concatenate([path.edges[:lo], np.array(way, dtype=np.int64), f_edges[int(f_counts[: unit + 1].sum()) :]]),
                np.concatenate([path.counts[:unit], [len(way)], f_counts[unit + 1 :]]),
                unit + 1,
                path.prefix[i] + p,
                seeds[r],
            )
            taken.append(way)
            left = 1.0 - sum(math.exp(sum(s.log_p[list(t)])) for t in taken)
            path.g[i] = _truncated(path.prefix[i] + math.log(left), bound, _one(seeds[r], unit, 1 << 23)) if left > _TINY else -math.inf
            paths.append(new)
            widen(new, bound)
        threshold = max(p.best() for p in paths)
        out = []
        for x in paths:
            p = float(x.log_p.sum())
            out.append((self.ids(s, x.edges, x.counts), p, _log_inclusion(p - threshold)))
        return out


_TINY = 1e-13
_WIDTH = 8


def _log_rest(log_p: float) -> float:
    """log(1 - exp(log_p)), and minus infinity where nothing measurable is left."""
    rest = -math.expm1(min(log_p, 0.0))
    return math.log(rest) if rest > _TINY else -math.inf


def _log_inclusion(above: float) -> float:
    """log(1 - exp(-exp(above))), ``above`` being the log-probability over the threshold."""
    if above < -30:
        return above
    return math.log(-math.expm1(-math.exp(min(above, 700.0))))


class Path:
    """An emitted segmentation and the subspaces that leave it from unit ``first`` on."""

    def __init__(self, log_p: np.ndarray, edges: np.ndarray, counts: np.ndarray, first: int, before: float, seed: int) -> None:
        self.log_p, self.edges, self.counts, self.first, self.before, self.seed = log_p, edges, counts, first, before, seed
        self.known = first  # subspaces are split as far as here
        self.prefix: list[float] = []
        self.g: list[float] = []
        self.behind = -math.inf  # the score of all that leave later
        self.taken: dict[int, list[tuple[int, ...]]] = {}

    def best(self) -> float:
        return max(max(self.g, default=-math.inf), self.behind)


SCHEMA = "doc_id bigint, sample int, n_pieces int, log_prob double, log_inclusion double, ids array<int>, text string"


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, theta: float = THETA, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each sample: doc_id, sample, n_pieces, log_prob, log_inclusion, ids and the decoded text.

    Columns of ``docs`` named in ``keep`` follow.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encode, decode = Encoder(vocab.value, k, theta), Decoder(vocab.value)
        for part in slices(batch, "text", 1 << 19):
            doc_ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            rows: list[int] = []
            keys = np.array([x or 0 for x in doc_ids], dtype=np.int64)
            for row, (doc_id, samples) in enumerate(zip(doc_ids, encode(keys, texts), strict=True)):
                rows += [row] * len(samples)
                for n, (ids, log_p, inclusion) in enumerate(samples):
                    out["doc_id"].append(doc_id)
                    out["sample"].append(n)
                    out["n_pieces"].append(len(ids))
                    out["log_prob"].append(log_p)
                    out["log_inclusion"].append(inclusion)
                    out["ids"].append(ids)
                    out["text"].append(decode(ids))
            yield out | {c: part.column(c).take(pa.array(rows, type=pa.int64())) for c in keep}

    target = T.StructType([*T.StructType.fromDDL(SCHEMA), *docs.select(*keep).schema])
    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *keep), run, target)


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every whole text: piece ids, the decoded text and their probabilities."""
    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
