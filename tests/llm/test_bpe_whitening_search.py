"""Byte-level BPE, whitening and ranked search against the libraries and brute force."""

import base64
import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import charpoly
from lorekeep.llm import op11_byte_bpe as op11
from lorekeep.llm import op12_embedding_whitening as op12
from lorekeep.llm import op13_ranked_search as op13

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "  \n ", "I'll don't 12345 it's\t\tO'K", "é🎉中文 naïve‍️", "a" * 5000, "\r\n\r\n  x  y", prose := "the thesened heention " * 300, prose, "<|endoftext|> x", "́́ ½ ² Ⅷ", "\x00\x7f\x80"]


def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return op11.Codec(op11.tokenizer_json(op11.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN))


def test_ids_of_random_texts(codec):
    """Mixed characters, strings of vocabulary entries and repeats encode as by the rank library, and decode to their bytes."""
    enc, rng = tiktoken_encoding(), random.Random(4)
    entries = codec.bytes
    for k in range(4000):
        if k % 4 == 0:
            t = "".join(rng.choice("aábc AB1'st \n🎉中") for _ in range(rng.randint(1, 60)))
        elif k % 4 == 1:
            t = b"".join(rng.choice(entries) for _ in range(rng.randint(1, 12))).decode("utf-8", "replace")
        elif k % 4 == 2:
            t = "".join(rng.choice("aab") for _ in range(rng.randint(1, 200)))
        else:
            t = b"".join(rng.choice(entries).strip() for _ in range(rng.randint(1, 8))).decode("utf-8", "ignore") * 3
        (ids,) = codec.encode([t])
        assert ids == enc.encode_ordinary(t)
        assert codec.decode(ids) == t.encode() and "".join(codec.pieces(ids)) == t


def test_ids_of_every_character(codec):
    enc = tiktoken_encoding()
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(s, s + 64) if not 0xD800 <= c < 0xE000) for s in range(0, 0x30000, 64)]
    assert codec.encode(texts) == [enc.encode_ordinary(t) for t in texts]


def test_parts_do_not_change_ids(codec, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", " ", "  ", "\n", "\t ", "é", "1", "!", "'s", " ", " "]) for _ in range(300)) for _ in range(60)]
    want = codec.encode(texts)
    for n in (1, 3, 17):
        monkeypatch.setattr(op11, "PART", n)
        assert any(len(op11._parts(t)) > 5 for t in texts) and all("".join(op11._parts(t)) == t for t in texts)
        assert codec.encode(texts) == want


def test_offsets_and_split_characters(codec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(codec.tokenizer.to_str())
    for t in ["a🎉b  é中", "naïve 🎉🎉", "x", ""]:
        (ids,) = codec.encode([t])
        starts, ends = codec.offsets(t, ids)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == library.encode(t, add_special_tokens=False).offsets
    (ids,) = codec.encode(["🎉"])
    assert len(ids) > 1 and codec.pieces(ids) == [""] * (len(ids) - 1) + ["🎉"]
    assert codec.pieces(ids[:-1])[-1] == "�"


def test_byte_bpe(spark):
    kind = "doc_id bigint, text string, ids string, starts string, n_tokens string"
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x", "x", "x"), (3, TEXTS[4], "x", "x", "x")]
    docs, enc = spark.createDataFrame(rows, kind), tiktoken_encoding()
    got = op11.round_trip(docs).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = op11.encode(docs)
    back = op11.decode(coded.unionByName(spark.createDataFrame([(99, None, None, None)], coded.schema))).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted([(i, t or "") for i, t, *_ in rows] + [(99, None)], key=str)
    assert all("".join(r.pieces) == r.text == bytes(r.bytes).decode() for r in back if r.text is not None)
    none = spark.createDataFrame([], kind)
    assert op11.round_trip(none).count() == op11.encode(none).count() == 0


def polynomial(m):
    ps = charpoly.primes(charpoly.primes_needed(m))
    return charpoly.combine(charpoly.modular_polynomials(m, ps), ps)


def test_characteristic_polynomials():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 6, 9):
        a = rng.integers(-9, 9, (max(1, d - 2), d)).astype(object)
        a[:, d // 2] = 0  # columns without a pivot
        m = [[int(v) for v in r] for r in a.T @ a]
        coefficients, x, eye = [1], np.zeros((d, d), dtype=object), np.array([[int(i == j) for j in range(d)] for i in range(d)], dtype=object)
        mo = np.array(m, dtype=object)
        for k in range(1, d + 1):  # Faddeev and LeVerrier
            x = mo @ x + coefficients[-1] * eye
            coefficients.append(-int(np.trace(mo @ x)) // k)
        assert polynomial(m) == coefficients[::-1]


def test_roots_and_null_vectors():
    diagonal = [9, 9, 4, 4, 4, 1, 0, 0]
    m = [[diagonal[i] if i == j else 0 for j in range(8)] for i in range(8)]
    roots = charpoly.largest_roots(polynomial(m), sum(diagonal), 8)
    assert [(round((lo + hi) / 2 / 2**b, 9), n) for lo, hi, b, n in roots] == [(9, 2), (4, 3), (1, 1)]
    for lo, hi, b, n in roots:
        v = np.array([[c / 2**charpoly.FIXED for c in y] for y in charpoly.null_vectors(m, lo, hi, b, n, 9)])
        assert np.allclose(v @ v.T, np.eye(n), atol=1e-14)
        value = round((lo + hi) / 2 / 2**b)
        assert np.allclose(np.delete(v, [i for i, x in enumerate(diagonal) if x == value], axis=1), 0, atol=1e-14)
    # two roots that doubles can't tell apart
    close = [[10**20 + 1, 0, 0], [0, 10**20, 0], [0, 0, 7]]
    roots = charpoly.largest_roots(polynomial(close), 2 * 10**20 + 8, 3)
    assert [n for *_, n in roots] == [1, 1, 1]
    assert abs(charpoly.null_vectors(close, *roots[1][:3], 1, 1)[0][1]) / 2**charpoly.FIXED > 1 - 1e-12


VECTORS = "vec_id bigint, embedding array<float>, label int, x string, c string, whole string"


def whitening_fixture():
    rng = np.random.default_rng(5)
    v = [rng.normal(size=6).astype(np.float32).round(3) * np.float32(0.3) for _ in range(300)]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(500 + i, rows[i][1]) for i in range(40)] + [(None, rows[0][1]), (7, rows[7][1])]
    rows += [(900, None), (901, []), (902, [0.1, None, 0.2, 0.0, 0.1, 0.1]), (903, [float("nan")] * 6), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (905, [-0.0] * 6)]
    return [(i, r, 1, "x", "x", "x") for i, r in rows]


def test_whitening(spark):
    rows = whitening_fixture()
    got = op12.whitened(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    whole = [(i, np.floor(256 * np.array(r, dtype=np.float32).astype(float)).astype(np.int64) + 0) for i, r, *_ in rows if r and None not in r and np.isfinite(r).all()]
    fit = np.unique(np.array([x for _, x in whole]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    w, e = np.linalg.eigh(np.cov(fit.T, bias=True))
    w, e = w[::-1], e[:, ::-1]
    assert len(got) == 4 * len(whole) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1
    want = {}
    for i, x in whole:
        for k in range(4):
            want.setdefault((i, k + 1), []).append((int(((n * x - s) ** 2).sum()), float((x - s / n) @ e[:, k] / math.sqrt(w[k]))))
    sign = {k: 0.0 for k in range(1, 5)}
    for r in got:
        deviation, value = want[r.vec_id, r.component][0]
        assert r.deviation == deviation and abs(abs(r.whitened) - abs(value)) < 1e-9
        assert abs(r.explained - w[r.component - 1] / w.sum()) < 1e-12
        if abs(value) > 1e-6:
            assert sign[r.component] in (0.0, math.copysign(1, r.whitened * value))
            sign[r.component] = math.copysign(1, r.whitened * value)


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, r, 1, "x", "x", "x") for i, r in enumerate(rows)], VECTORS)
    assert op12.whitened(make([])).count() == 0 and op12.whitened(make([None, []])).count() == 0
    assert op12.whitened(make([[0.5, 0.5]] * 3)).count() == 0  # no positive root
    line = op12.whitened(make([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])).collect()  # one positive root
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in line) == [(i, 1, 2, 1.0, 1.0) for i in range(3)]
    square = op12.whitened(make([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])).collect()  # equal roots
    assert max(r.identity_error for r in square) < 1e-12 and {r.explained for r in square} == {0.5}
    with pytest.raises(Exception, match="unequal"):
        op12.whitened(make([[0.0, 1.0], [1.0]])).count()
    with pytest.raises(OverflowError):
        op12._deviations(np.array([[1 << 40]], dtype=np.int64))


def test_products_are_exact():
    for most in (100, 1 << 26, 1 << 40):
        x = np.random.default_rng(1).integers(-most, most, (50, 3))
        assert op12._products(x).tolist() == (x.astype(object).T @ x.astype(object)).tolist()


SEARCHED = "doc_id bigint, text string, terms string, n string, rank string"
ASKED = "item_id bigint, text string, doc_id string, terms string"


def search_fixture(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "中文", "x9", "The"]
    pick = lambda: vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)]
    docs = [(i if i % 17 else i // 17, rng.choice([" ", ", ", "-", "_"]).join(pick() for _ in range(rng.randint(0, 40)))) for i in range(n)]
    docs += [(None, "w1 w2 w3"), (None, None), (5000, None), (5001, ""), (5002, "!!! --"), (5003, "W1 w1 w1"), (5003, "W1 w1 w1"), (5004, "w1_w1 w1"), (5005, "w7 " * 3000)]
    items = [(i, " ".join(pick() for _ in range(rng.randint(1, 25)))) for i in range(20)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w1 w1"), (103, "w1 w1"), (103, "W2"), (None, "w3"), (104, "the THE É é 中文")]
    return [(*d, "x", "x", "x") for d in docs], [(*i, "x", "x") for i in items]


@pytest.mark.parametrize("run, size, terms", [(4096, 32 << 20, 200_000), (1, 300, 40), (7, 3000, 100)])
def test_ranked_search(spark, monkeypatch, run, size, terms):
    """The SQL's rows, whatever the sizes of runs, shards and blocks."""
    monkeypatch.setattr(op13, "RUN", run)
    monkeypatch.setattr(op13, "SHARD_BYTES", size)
    monkeypatch.setattr(op13, "BLOCK_TERMS", terms)
    docs, items = search_fixture(run, 250)
    got = op13.ranked(spark.createDataFrame(docs, SEARCHED), spark.createDataFrame(items, ASKED)).select("item_id", "rank", "doc_id", "score").collect()
    con = duckdb.connect()
    # pandas would turn the ids to floats where some are null
    d, i = (pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), (pa.int64(), pa.string()), strict=False)}) for names, rows in ((["doc_id", "text"], docs), (["item_id", "text"], items)))
    con.register("documents", d)
    con.register("benchmark", i)
    want = con.execute(op13.SQL).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 200


def test_search_of_empty_tables(spark):
    docs, items = search_fixture(1, 5)
    docs, items = spark.createDataFrame(docs, SEARCHED), spark.createDataFrame(items, ASKED)
    assert op13.ranked(docs.limit(0), items).count() == 0 and op13.ranked(docs, items.limit(0)).count() == 0
    assert op13.ranked(docs.where("text is null"), items).count() == 0


def test_search_prunes(monkeypatch):
    """Lists that can't reach the tenth best are looked up at candidates alone, and the results are those of scoring everything."""
    rng = np.random.default_rng(3)
    n, terms = 20_000, 6
    lengths = rng.integers(5, 400, n)
    held = [np.sort(rng.choice(n, k, replace=False)) for k in (50, 200, 4000, 9000, 15000, 19000)]
    counts = [rng.integers(1, 6, len(h)) for h in held]
    row = {"ids": list(range(n)), "lengths": lengths.astype("<i8").tobytes(), "terms": np.arange(terms).astype("<i4").tobytes(), "starts": np.cumsum([0] + [len(h) for h in held]).astype("<i4").tobytes(), "docs": np.concatenate(held).astype("<i4").tobytes(), "counts": np.concatenate(counts).astype("<i4").tobytes()}
    total = int(lengths.sum())
    shard, best = op13.ShardSearch(row, n, total), op13.Best()
    weights = op13.weights_of(np.array([len(h) for h in held]), n)
    seen = []
    offer = op13.Best.offer
    monkeypatch.setattr(op13.Best, "offer", lambda self, scores, ids, null: (seen.append(len(ids)), offer(self, scores, ids, null)))
    shard.search(np.arange(terms), weights, best)
    score = np.zeros(n, dtype=np.int64)
    for h, c, w in zip(held, counts, weights, strict=True):
        score[h] += w * op13.impacts(c, lengths[h], n, total)
    order = np.lexsort((np.arange(n), -score))[:10]
    assert [(-s, d) for s, _, d in best.rows] == [(score[d], d) for d in order]
    assert len(seen) < 12  # later runs propose little


def test_long_texts(spark):
    wide = "tala riné " * (1 << 17)  # over 1 MB
    rows = [(1, wide), (2, "ab" * (1 << 19)), (3, wide)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in op11.round_trip(docs).collect()}
    assert got[1].ids_sha256 == got[3].ids_sha256 and got[1].n_tokens > 1 << 18
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    asked = spark.createDataFrame([(1, "TALA")], "item_id bigint, text string")
    assert [(r.rank, r.doc_id) for r in op13.ranked(docs, asked).orderBy("rank").collect()] == [(1, 1), (2, 3)]
    assert op13.ranked(docs, asked).where(F.col("score") <= 0).count() == 0
