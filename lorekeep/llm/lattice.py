"""Unigram lattices over words, for many words at once, with numpy.

A vocabulary of scored pieces is an Aho-Corasick automaton over bytes: failure links
are compiled into its transitions, and output links lead from a state to the
pieces that end there too.  One pass over the bytes enumerates every match;
many units, and pieces of long ones, pass side by side.  Pieces never run across the start
of a space run or over a line feed (``Vocabulary.read`` raises if one does), so a text's lattice falls apart into units
``" *[^ ]*"`` and single line feeds, and equal units share one lattice.

Characters without a piece of their own become byte pieces (byte fallback).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .hashing import range_hashes

SPACE = 0xFF  # stands for the word mark; never a byte of UTF-8
MARK = "▁"
LANE = 256


@dataclass
class Vocabulary:
    """Pieces with scores, from a sentencepiece model file read on the driver."""

    pieces: list[bytes]  # the word mark as SPACE
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray  # the id of each byte piece
    unknown: float  # the score of a character without a piece
    _automaton: tuple | None = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, ids, scores, byte_ids = [], [], [], np.full(256, -1, dtype=np.int64)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append(sp.id_to_piece(i).replace(MARK, "\0").encode().replace(b"\0", bytes([SPACE])))
                ids.append(i)
                scores.append(sp.get_score(i))
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(sp.serialized_model_proto())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.escape_whitespaces:
            raise ValueError(f"{path} changes texts before it cuts them")
        if (byte_ids < 0).any():
            raise ValueError(f"{path} has no byte pieces for unknown characters")
        for p in pieces:
            if bytes([SPACE]) in p.lstrip(bytes([SPACE])) or b"\n" in p and len(p) > 1:
                raise ValueError(f"{path} has a piece {p!r} that runs over the end of a word or line")
        # files of merge rules give a very low score to pieces that no rule makes; they come last here
        floor = min(s for s in scores if s > -1e8) - 10.0
        return cls(pieces, np.array(ids), np.maximum(np.array(scores, dtype=np.float64), floor), byte_ids, floor - 10.0)

    def automaton(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Next state of each state and byte, the piece that ends in each state (or -1), its output link (0: none), and sizes of pieces."""
        if self._automaton is None:
            prefixes = sorted({p[:j] for p in self.pieces for j in range(len(p) + 1)}, key=len)
            number = {p: i for i, p in enumerate(prefixes)}
            n = len(prefixes)
            follow = np.zeros((n, 256), dtype=np.uint16 if n < 1 << 16 else np.uint32)
            parent, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for p, i in number.items():
                if p:
                    parent[i], last[i] = number[p[:-1]], p[-1]
                    follow[parent[i], last[i]] = i
            piece = np.full(n, -1, dtype=np.int32)
            for i, p in enumerate(self.pieces):
                piece[number[p]] = i
            fail, link = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            depth = np.array([len(p) for p in prefixes])
            for d in range(1, depth[-1] + 1):  # a failure link leads to a shallower state, whose transitions are complete
                s = np.arange(*np.searchsorted(depth, [d, d + 1]))
                fail[s] = follow[fail[parent[s]], last[s]] if d > 1 else 0
                link[s] = np.where(piece[fail[s]] >= 0, fail[s], link[fail[s]])
                follow[s] = np.where(follow[s] > 0, follow[s], follow[fail[s]])
            self._automaton = follow.ravel(), piece, link, np.array([len(p) for p in self.pieces], dtype=np.int32)
        return self._automaton

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one buffer with word marks, unit starts and ends, and each text's first unit."""
    parts, sizes = [], []
    for t in texts:
        # the mark itself is the same as a space, as the tokenizer has it
        raw = (" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b""
        parts.append(raw)
        sizes.append(len(raw))
    b = np.frombuffer(b"".join(parts), dtype=np.uint8).copy()
    b[b == 32] = SPACE
    heads = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    cut = np.zeros(len(b) + 1, dtype=bool)
    mark, feed = b == SPACE, b == 10
    cut[1:-1] = mark[1:] & ~mark[:-1] | feed[1:] | feed[:-1]
    cut[heads] = True
    at = np.flatnonzero(cut)
    starts, ends = (at[:-1], at[1:]) if len(b) else (at[:0], at[:0])
    return b, starts, ends, np.searchsorted(starts, heads)


def distinct(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and one instance of each distinct unit, and for each instance its distinct unit."""
    return np.unique(range_hashes(b, starts, ends), return_index=True, return_inverse=True)


@dataclass
class Lattice:
    """Edges of many units laid end to end: from byte ``a`` to byte ``z``, piece index (-1: bytes)."""

    bytes: np.ndarray
    heads: np.ndarray  # where each unit begins; one more at the end
    a: np.ndarray
    z: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    offset: np.ndarray  # of each byte in its unit


def matches(vocab: Vocabulary, own: np.ndarray, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and pieces of all matches in units that lie end to end.

    Units longer than ``LANE`` bytes pass in lanes, each of which begins as many
    bytes early as the longest piece has: its state is then that of a pass over the whole unit.
    """
    follow, piece, link, size = vocab.automaton()
    sizes = np.diff(heads)
    lanes = np.maximum(1, -(-sizes // LANE))
    unit = np.repeat(np.arange(len(sizes)), lanes)
    first = heads[unit] + LANE * (np.arange(len(unit)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(first + LANE, heads[unit + 1])
    start = np.maximum(first - int(size.max(initial=0)), heads[unit])
    order = np.argsort(start - stop, kind="stable")  # longest first
    first, stop, start = first[order], stop[order], start[order]
    width = stop - start
    state = np.zeros(len(unit), dtype=np.int64)
    for j in range(int(width[0]) if len(width) else 0):
        live = int(np.searchsorted(-width, -j))  # lanes of more than j bytes
        at = start[:live] + j
        state[:live] = follow[state[:live] << 8 | own[at]]
        s = state[:live]
        s = np.where(piece[s] >= 0, s, link[s])
        s[at < first[:live]] = 0
        hit = np.flatnonzero(s)
        s, z = s[hit], at[hit] + 1
        while len(s):
            yield z - size[piece[s]], z, piece[s]
            s = link[s]
            more = np.flatnonzero(s)
            s, z = s[more], z[more]


def build(vocab: Vocabulary, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lattice:
    sizes = (ends - starts).astype(np.int32)
    heads = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    total = int(heads[-1])
    offset = np.arange(total, dtype=np.int32) - np.repeat(heads[:-1], sizes)
    own = b[np.repeat(starts.astype(np.int32), sizes) + offset]
    stop = np.repeat(heads[1:], sizes)
    char_at = np.flatnonzero((own & 0xC0) != 0x80).astype(np.int32)
    char_end = np.minimum(np.append(char_at[1:], np.int32(total)), stop[char_at])
    width = np.zeros(total, dtype=np.int32)
    width[char_at] = char_end - char_at
    found = [(np.zeros(0, dtype=np.int32),) * 3, *matches(vocab, own, heads)]
    a, z, n = (np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True))
    single = np.zeros(total, dtype=bool)
    single[a[z - a == width[a]]] = True
    lone = char_at[~single[char_at]]
    a, z, n = np.concatenate([a, lone]), np.concatenate([z, lone + width[lone]]), np.concatenate([n, np.full(len(lone), -1, dtype=np.int32)])
    return Lattice(own, heads, a, z, n, np.where(n >= 0, vocab.scores[n], vocab.unknown), offset)


def _steps(order_by: np.ndarray) -> Iterator[np.ndarray]:
    """Indices grouped by ascending value (a radix sort, as offsets in words are small)."""
    if len(order_by) and order_by.max() < 1 << 16:
        order_by = order_by.astype(np.uint16)
    order = np.argsort(order_by, kind="stable")
    v = order_by[order]
    cuts = np.flatnonzero(np.diff(v)) + 1
    yield from np.split(order, cuts) if len(order) else ()


def best_counts(lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Best score and its number of pieces for each unit.

    The tokenizer's tie rule: positions are left in ascending order and a node
    takes a new path only if it is strictly better, so of equal scores the path
    whose last piece began first (the longest piece) stays.
    """
    size = int(lat.heads[-1]) + len(lat.heads)
    # byte x of unit u is node x + u, so that a unit's end isn't the next one's start
    node = np.repeat(np.arange(len(lat.heads) - 1, dtype=np.int32), np.diff(lat.heads))
    best, count = np.full(size, -np.inf), np.zeros(size, dtype=np.int32)
    roots = lat.heads[:-1] + np.arange(len(lat.heads) - 1)
    best[roots] = 0.0
    s, e = lat.a + node[lat.a], lat.z + node[lat.a]
    cost = np.where(lat.piece >= 0, 1, lat.z - lat.a)
    for i in _steps(lat.offset[lat.a]):
        cand = best[s[i]] + lat.score[i]
        won = cand > best[e[i]]
        j = i[won]
        best[e[j]] = cand[won]
        count[e[j]] = count[s[j]] + cost[j]
    tails = lat.heads[1:] + np.arange(len(lat.heads) - 1)
    return best[tails], count[tails]


@dataclass
class Sampler:
    """Backward choice of edges: for each node its incoming edges."""

    lat: Lattice
    order: np.ndarray  # edges by end node
    start: np.ndarray  # node where the edge at a place begins
    log_p: np.ndarray
    upto: np.ndarray  # probability of the node's edges up to this one; above 1 at the last
    lo: np.ndarray  # first place of each node; one more at the end
    ids: np.ndarray | None = None  # vocabulary ids of the edges


def sampler(lat: Lattice, theta: float) -> Sampler:
    """Forward sums of exp(theta * score) over all segmentations."""
    n = len(lat.heads) - 1
    unit = np.repeat(np.arange(n, dtype=np.int32), np.diff(lat.heads))
    u = unit[lat.a]
    s, e, w = lat.a + u, lat.z + u, lat.score * theta
    size = int(lat.heads[-1]) + n + 1
    forward = np.full(size, -np.inf)
    forward[lat.heads[:-1] + np.arange(n)] = 0.0
    order = np.argsort(e, kind="stable")
    s, e, w = s[order], e[order], w[order]
    end_offset = lat.offset[lat.a[order]] + (e - s)
    for i in _steps(end_offset):  # within a step the edges stay in order of their end node
        v, ends = forward[s[i]] + w[i], e[i]
        cut = np.flatnonzero(np.diff(ends, prepend=-1))
        top = np.maximum.reduceat(v, cut)
        runs = np.diff(np.append(cut, len(i)))
        forward[ends[cut]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, runs)), cut))
    log_p = forward[s] + w - forward[e]
    p = np.exp(log_p)
    lo = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(np.bincount(e, minlength=size), out=lo[1:])
    first = lo[:-1][lo[:-1] < lo[1:]]
    c = np.cumsum(p)
    runs = np.diff(np.append(first, len(e)))
    upto = c - np.repeat(c[first] - p[first], runs)
    upto[first + runs - 1] = 2.0
    return Sampler(lat, order, s, log_p, upto, lo)
