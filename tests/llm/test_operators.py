"""The training-data operators on small tables against brute force, with nulls, empties, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import hashing as H
from lorekeep.llm import hyperminhash as M
from lorekeep.llm import lattice as L
from lorekeep.llm import op1_substring_dedup as op1
from lorekeep.llm import op2_suffix_array_dedup as op2
from lorekeep.llm import op3_media_png as op3
from lorekeep.llm import op4_order_minhash as op4
from lorekeep.llm import op5_source_mixing as op5
from lorekeep.llm import op6_token_counts as op6
from lorekeep.llm import op7_sentencepiece_sampling as op7
from lorekeep.llm import op8_language_id as op8
from lorekeep.llm import op9_quality_classifier as op9
from lorekeep.llm import op10_minhash_near_dedup as op10
from lorekeep.llm import lsh, tables, windows
from lorekeep.llm.tables import components

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, n string, line string, sig string, rep string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "se", "lu", "né"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edit(text, seed, share):
    rng, w = random.Random(seed), text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"x{rng.randint(0, 9999)}"
    return " ".join(w)


def corpus():
    base, passage = prose(0, 120), prose(1, 60)
    texts = [base, base, base.upper(), edit(base, 1, 0.01), edit(base, 2, 0.02), prose(2, 200), passage, prose(3, 30) + "\n" + passage + "\n" + prose(4, 20)]
    texts += [None, "", "  \n ", "word", "word", "two words", "a▁b  c\n\n🎉 中文", prose(5, 3000), prose(6, 60) + "\n" + edit(passage, 3, 0.01)]
    texts += [edit(base, 10 + i, 0.03) for i in range(40)]  # a bucket beyond the small ones
    rows = [(i * 3, t, ["en", "de", None][i % 3], [None, "a", "b", "a"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", "a", 1), (None, None, None, None, None)]
    return [(*r, "x", "x", "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def closure(n, links):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for y in w for x in y.replace("\t", "\n").split("\n") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_hashes():
    b, s, e, h = H.words("Über  the\tthe\nthe")
    assert len(h) == 4 and h[1] == h[2] == h[3] and h[0] != h[1]
    assert np.array_equal(H.shingles(h, 2)[1:], H.shingles(h[1:], 2))
    codes = np.arange(50, dtype=np.uint32) % 7
    for k in (1, 2, 3, 5, 8, 13):
        got = H.kmers(codes, k)
        assert len(got) == 51 - k and np.array_equal(got[:-7], got[7:]) and len(set(got.tolist())) == 7
    assert len(H.kmers(codes[:2], 8)) == 1 and len(H.kmers(codes[:0], 8)) == 0


def test_hyperminhash_estimates():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
            cut = round(1000 * (1 - share))
            a, b = np.sort(x[: 2000 - cut]), np.sort(x[cut:])
            true = (2000 - 2 * cut) / 2000
            est, _ = M.similarity(M.registers(a)[None], M.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
            errors.append(est[0] - true)
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, none, k):
    rows = [(r[0], r[1]) for r in corpus()]
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    links = [(x, y) for x, y in itertools.combinations(range(len(ids)), 2) if (a := sets[ids[x]]) and (b := sets[ids[y]]) and 100 * len(a & b) >= 80 * len(a | b)]
    comp = dict(zip(ids, (ids[c] for c in closure(len(ids), links)), strict=True))
    got = op10.near_duplicates(docs, shingle_words=k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    kept = op10.drop_near_duplicates(docs, shingle_words=k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [i for i in ids if comp[i] == i]
    assert op10.near_duplicates(none).count() == 0


def test_near_duplicates_writes_few_tables(spark, docs, monkeypatch):
    written = []
    for module in (tables, lsh, op10):
        monkeypatch.setattr(module, "materialise", lambda df, name, *a, real=module.materialise: (written.append(name), real(df, name, *a))[1])
    op10.near_duplicates(docs, shingle_words=2).collect()
    assert len(written) <= 16, written


def test_join_with_by_key_splits_a_hot_key(spark):
    rows = spark.range(0, 40000, 1, 4).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id")).alias("key"), "id")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        out = rows.join(tables.by_key(rows, "key", low=F.min("id"), n=F.count("id")).hint("merge"), "key")
        assert sorted(tuple(r) for r in out.collect()) == sorted((0, i, 0, 32000) if i % 10 < 8 else (i, i, i, 1) for i in range(40000))
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in conf:
            spark.conf.unset(name)


def plain_words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def plain_spans(rows, percent=80):
    """Content-defined paragraphs, exact Jaccard, clusters, and windows around outer paragraphs restated plainly: {(doc_id, text): [(start, end)]}."""
    docs = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: (r[0], tag_of(r[1])))
    split = [plain_words(t) for _, t in docs]
    found = []
    begun = [op1.begins(H.words(t)[3], 50) for _, t in docs]
    often = collections.Counter(x for _, chosen in begun for x in chosen.tolist())
    for d, (at, chosen) in enumerate(begun):
        for p in [p for p, x in zip(at.tolist(), chosen.tolist(), strict=True) if often[x] > 1]:
            w = split[d][p : p + 21]
            found.append((d, p, {tuple(w[j : j + 5]) for j in range(17)}))
    links = [(x, y) for x, y in itertools.combinations(range(len(found)), 2) if 100 * len(found[x][2] & found[y][2]) >= percent * len(found[x][2] | found[y][2])]
    cluster = closure(len(found), links)
    later = {found[x][:2] for x, c in enumerate(cluster) if x != c}
    outer = {c for (d, p, _), c in zip(found, cluster, strict=True) if (d, p) in later and not all(any((d, q) in later for q in near) for near in (range(p - 21, p), range(p + 1, p + 22)))}
    windows = {}
    for (d, p, _), c in zip(found, cluster, strict=True):
        for b in range(30) if c in outer else ():
            if 0 <= p - b <= len(split[d]) - 50:
                windows.setdefault((c, b, *split[d][p - b : p], *split[d][p + 21 : p - b + 50]), set()).add((d, p - b))
    spans = {}
    for d, p in later:
        spans.setdefault(d, []).append((p, p + 21))
    for places in windows.values():
        for d, p in sorted(places)[1:]:
            spans.setdefault(d, []).append((p, p + 50))
    out = {}
    for d, held in spans.items():
        joined = []
        for a, z in sorted(held):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(z, joined[-1][1]))
            else:
                joined.append((a, z))
        if joined := [(a, z) for a, z in joined if z - a >= 50]:
            out[docs[d]] = joined
    return out


def tag_of(text):
    """Any order of unlike texts under one doc_id would do; the tests hold none whose order matters."""
    return text


def shared_words(rows):
    """{doc_id: words of 50-word passages that occur before}."""
    where, want = {}, {}
    for i, t in sorted(rows):
        w = plain_words(t)
        for j in range(len(w) - 49):
            where.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    for places in where.values():
        for i, j in places[1:]:
            want.setdefault(i, set()).update(range(j, j + 50))
    return want


def test_substring_dedup(docs, none):
    rows = [(r[0], r[1]) for r in corpus()]
    want = plain_spans(rows)
    got = {}
    for r in op1.repeated_spans(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50 and r.first_doc_id <= r.doc_id
    assert {i: sorted(v) for i, v in got.items()} == {i: v for (i, _), v in want.items()} and len(want) > 10
    out = op1.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for i, t in rows:
        if (i, t or "") not in want:
            assert t in texts[i]
        else:
            w = plain_words(t)
            left = [x for j, x in enumerate(w) if not any(a <= j < z for a, z in want[i, t])]
            assert left in [plain_words(x) for x in texts[i]]
    assert op1.repeated_spans(none).count() == 0 and op1.without_repeats(none).count() == 0


def test_linked_paragraphs_share_a_key():
    """Whatever the paragraphs, two of a Jaccard similarity of 0.8 share a link key."""
    rng, held = random.Random(8), []
    for n in range(1200):
        vocabulary = rng.choice([2, 3, 4, 6, 40])
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(21)]
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.choice([0, 20, rng.randrange(21)])
                w = rng.choice([w[:at] + ["z"] + w[at:], w[:at] + w[at + 1 :] + ["y"], w[:at] + ["x"] + w[at + 1 :], w[1:] + w[:1], ["v", *w]])[:21]
            held.append((n, w))
    for percent in (60, 80, 90):
        pairs = found = 0
        keys = [{k for k in op1.link_keys(H.words(" ".join(w))[3], np.array([0]), percent)[0].tolist() if k} for _, w in held]
        sets = [{tuple(w[j : j + 5]) for j in range(17)} for _, w in held]
        for x, y in ((x, y) for i in range(0, len(held), 3) for x, y in itertools.combinations(range(i, i + 3), 2)):
            if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                pairs += 1
                found += bool(keys[x] & keys[y])
        assert found == pairs > 500


def changed_begins():
    """Texts whose copies differ in the first word of a paragraph or near it, also where words repeat."""
    rng, rows = random.Random(21), [(r[0], r[1]) for r in corpus()]
    for i in range(12):
        base = prose(7000 + i, 90).split(" ")
        if i % 3 == 2:
            base[20:60] = [rng.choice(["la", "le", "li"]) for _ in range(40)]
        rows.append((2000 + 10 * i, " ".join(base)))
        at = op1.begins(H.words(" ".join(base))[3], 50)[0].tolist()
        for j, p in enumerate(at[:6]):
            rows.append((2001 + 10 * i + j, " ".join(base[:p] + [f"other{i}{j}"] + base[p + 1 :])))
    return rows


def test_every_paragraph_is_compared(spark):
    """Linked paragraphs are members of a cluster, also those whose begin occurs once; exact Jaccard over all pairs restated plainly."""
    rows = changed_begins()
    texts = sorted({(i, t or "") for i, t in rows if i is not None})
    found, begun = [], collections.Counter()
    for i, t in texts:
        at, chosen = op1.begins(H.words(t)[3], 50)
        begun.update(chosen.tolist())
        w = plain_words(t)
        found += [(i, p, x, {tuple(w[p + j : p + j + 5]) for j in range(17)}) for p, x in zip(at.tolist(), chosen.tolist(), strict=True)]
    links = [(x, y) for x, y in itertools.combinations(range(len(found)), 2) if 100 * len(found[x][3] & found[y][3]) >= 80 * len(found[x][3] | found[y][3])]
    cluster = closure(len(found), links)
    size = collections.Counter(cluster)
    want = collections.Counter((i, p) for (i, p, *_), c in zip(found, cluster, strict=True) if size[c] > 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.pos) for r in op1._members(op1.tagged(docs), 50, 80, True).collect())
    assert got == want and sum(begun[found[x][2]] == 1 for x in range(len(found)) if size[cluster[x]] > 1) > 10


def test_query_compares_every_paragraph(spark, tmp_path, monkeypatch):
    """The query's spans are those of all paragraphs: a copy whose one changed word begins a paragraph is one span."""
    begins, rows = op1.begins, [(r[0], r[1]) for r in corpus()]
    with monkeypatch.context() as m:
        m.setattr(op1, "begins", lambda h, n: (begins(h, n)[0], 0 * begins(h, n)[1]))  # one begin for all, which occurs often
        want = plain_spans(rows)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in op1.op1_substring_dedup(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert {i: sorted(v) for i, v in got.items()} == {i: v for (i, _), v in want.items()} and got[57] == [(11, 120)]


def test_stage_compares_every_paragraph(spark, tmp_path):
    """The pipeline's stage cuts a copy whose one changed word begins a paragraph, as one passage."""
    rows = [(r[0], r[1]) for r in corpus()]
    left = {r.text for r in corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path)).where("doc_id = 57").collect()}
    assert left == {op1.cut(t, [(11, 120)]) for i, t in rows if i == 57}


@pytest.mark.parametrize("seed", [4735, 6852])
def test_link_without_a_band(seed):
    """Two of 12,000 pairs of paragraphs that differ in their last word share no band key; they share a link key."""
    one, passage = np.array([0]), " ".join(f"w{seed}x{i}" for i in range(20))
    x, y = (H.words(f"{passage} {end}")[3] for end in ("this", "that"))
    bands = [set(op1.band_keys(op1.sets_at(H.shingles(h, op1.SHINGLE), one))[0].tolist()) for h in (x, y)]
    assert not bands[0] & bands[1]
    assert set(op1.link_keys(x, one, 80)[0].tolist()) & set(op1.link_keys(y, one, 80)[0].tolist()) - {0}


def test_cut_keeps_line_ends():
    assert op1.cut("a b\nc d e\nf", [(2, 5)]) == "a b\nf" and op1.cut("a b c\nd e", [(1, 3)]) == "a\nd e"
    assert op1.cut("a\nb c d", [(1, 3)]) == "a\nd" and op1.cut("a b c d", [(1, 3)]) == "a d"
    assert op1.cut(" a b c", [(0, 2)]) == "c" and op1.cut("a b", [(0, 2)]) == "" and op1.cut("ä b ç d é", [(0, 1), (2, 3)]) == "b d é"


def test_repeated_passages_across_documents(spark):
    """Passages of 50 words and more over line ends: whole recall, clean documents left alone; unlike texts under one doc_id."""
    rng, rows = random.Random(5), []
    passages = [prose(900 + i, 50 + i) for i in range(12)]
    for i in range(150):
        w = prose(i, 80).split(" ")
        if i % 3 == 0:
            at = rng.randint(0, 80)
            w[at:at] = passages[i % 12].split(" ")
        rows.append((1000 - i, "".join(x + ("\n" if j % (7 + i % 5) == 6 else " ") for j, x in enumerate(w))))
    rows += [(1000, rows[3][1]), (1000, prose(5000, 90))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = op1.without_repeats(df)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for p in passages[::3]:
        held = [i for i, ts in got.items() for t in ts if " ".join(plain_words(p)) in " ".join(plain_words(t))]
        assert len(held) == 1
    assert all(t in got[i] for n, (i, t) in enumerate(rows) if n % 3 and n < 150 and n != 3) and rows[-1][1] in got[1000]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = shared_words([tuple(r) for r in docs.collect()])
    got = {}
    for r in op1.repeated_spans(docs).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert all(w <= got.get(i, set()) for i, w in want.items())  # no word of a repeated passage is missing
    n = docs.count()
    assert len(set(got) - set(want)) <= 0.01 * n


def test_suffixes(docs, none):
    got = {}
    for r in op2.repeated_spans(docs).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    where = {}
    texts = {i: (t or "") for i, t, *_ in corpus() if i is not None}
    for i in sorted(texts):
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in texts[i].split()]
        for j in range(len(w) - 49):
            where.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    want = {}
    for places in where.values():
        for i, j in places[1:]:
            want.setdefault(i, set()).update(range(j, j + 50))
    assert got == want
    assert op2.repeated_spans(none).count() == 0


@pytest.mark.parametrize("size", [1, 3, 16, 1 << 15])
def test_suffixes_in_chunks(spark, docs, monkeypatch, size):
    """Runs over the borders of chunks give the same passages, however the sorted rows are cut."""
    rng = np.random.default_rng(size)
    n, need = 400, 12
    right, left = rng.integers(0, 2, (n, 12)).astype(np.uint32), rng.integers(0, 2, (n, 9)).astype(np.uint32)
    near = rng.integers(0, 4, n)
    rows = sorted(zip(rng.integers(0, 2, n).tolist(), right.tolist(), left.tolist(), range(n), near.tolist(), (near + rng.integers(0, 6, n)).tolist(), strict=True))
    got, open_ = set(), {}
    for i in range(0, n, size):
        part = rows[i : i + size]
        anchor, r, lft, doc, lo, hi = (np.array(c) for c in zip(*part, strict=True))
        later, first, edge, keys = windows.decide(anchor, r.astype(np.uint32), lft.astype(np.uint32), np.stack([doc, 0 * doc, 0 * doc], axis=1), lo, hi, need)
        for x, b in zip(*np.nonzero(later), strict=True):
            got.add((doc[x], b))
            assert doc[first[x, b]] < doc[x]
        for x, b in zip(*np.nonzero(edge & ~later), strict=True):
            open_.setdefault(keys[x, b], []).append((doc[x], b))
    for places in open_.values():
        got |= set(sorted(places)[1:])
    held = {}
    for a, r, lft, d, lo, hi in rows:
        for b in range(lo, hi + 1):
            held.setdefault((a, b, *lft[:b], *r[: need - b]), []).append((d, b))
    assert got == {x for places in held.values() for x in sorted(places)[1:]}


@pytest.mark.parametrize("size", [1, 3, 16, 400])
def test_open_windows_in_chunks(size):
    """Spans of chunks and the firsts of windows that several chunks hold together give every window that occurs before, with its first document."""
    rng, n, need, sides = np.random.default_rng(size), 400, 10, (10, 8)
    right, left = rng.integers(0, 2, (n, sides[0])), rng.integers(0, 2, (n, sides[1]))
    right[::5], left[::5] = right[0], left[0]  # places with equal words on both sides
    near = rng.integers(0, 3, n)
    columns = {"anchor": rng.integers(0, 2, n), "right": windows.binary(right.astype(">u4")), "left": windows.binary(left.astype(">u4")), "doc_id": rng.permutation(n) // 4, "tag": np.zeros(n, dtype=np.int32), "pos": rng.permutation(n).astype(np.int32) + 20, "near": near.astype(np.int32), "far": (near + rng.integers(0, 6, n)).astype(np.int32)}
    rows = pa.table(columns)
    cut = lambda t, fn, *order: pa.Table.from_batches([fn(t.slice(i, size), *sides, need) for i in range(0, t.num_rows, size)]) if (t := t.sort_by([(c, "ascending") for c in (*order, "doc_id", "tag", "pos")])).num_rows else None
    found = cut(rows, windows._chunk, "anchor", "right")
    shared = cut(found.filter(pc.is_valid(found["windows"])), windows._shared, "anchor", "left")
    open_, spans = {}, []
    for r in shared.to_pylist() if shared else ():
        open_.setdefault(r["key"], []).append((r["doc_id"], r["low"]))
    for r in found.filter(pc.is_null(found["windows"])).to_pylist():
        first = min([r["first_doc_id"], *(d for d, _ in open_.get(r["key"], ()))])
        spans.append((r["doc_id"], r["low"], r["high"] + need, first))
    spans += [(d, low, low + need, min(places)[0]) for places in open_.values() for d, low in sorted(places)[1:]]
    held, first_of, want, got = {}, {}, {}, {}
    for r, a, z in zip(rows.to_pylist(), left.tolist(), right.tolist(), strict=True):
        for b in range(r["near"], min(r["far"], sides[1]) + 1):
            held.setdefault((r["anchor"], b, *a[:b], *z[: need - b]), []).append((r["doc_id"], r["pos"], b))
    for places in held.values():
        for d, p, b in sorted(places)[1:]:
            want.setdefault(d, set()).update(range(p - b, p - b + need))
            first_of.setdefault((d, p - b), set()).add(min(places)[0])
    for d, low, end, first in spans:
        got.setdefault(d, set()).update(range(low, end))
        assert first in first_of[d, low]
    assert got == want


def test_rows_of_a_common_anchor():
    """A place of a common passage is one row at most, whatever surrounds it; windows that only one place has go no further."""
    n, need = 600, 29
    one, left = np.ones(n, dtype=np.int64), np.arange(n * need).reshape(n, need) + 100
    left[:, :3] = 7
    same = {"anchor": one, "right": windows.binary(np.ones((n, need), dtype=">u4")), "left": windows.binary(left.astype(">u4")), "doc_id": np.arange(n), "tag": one.astype(np.int32), "pos": 100 * one.astype(np.int32), "near": 0 * one.astype(np.int32), "far": need * one.astype(np.int32)}
    made = [windows._chunk(pa.table(same).slice(i, 60), need, need, need) for i in range(0, n, 60)]
    assert sum(m.num_rows for m in made) <= 2 * n
    found = pa.Table.from_batches(made)
    open_ = found.filter(pc.is_valid(found["windows"])).sort_by([(c, "ascending") for c in ("anchor", "left", "doc_id")])
    assert windows._shared(open_.combine_chunks(), need, need, need).num_rows <= 200


def test_places_are_read_once(spark, tmp_path):
    """The words around places are computed once, though the rows are sorted by ranges."""
    rows = [(a, bytes([i]) * 40, bytes([i]) * 40, i, 0, 50, 0, 9) for i in range(40) for a in (1, 2)]
    df, seen = spark.createDataFrame(rows, windows.ROWS).coalesce(1), str(tmp_path / "seen")

    def count(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    windows.repeated_windows(df.mapInArrow(count, windows.ROWS), 10, 10, 10)
    assert sum(map(int, open(seen).read().split())) == len(rows)


def test_sets_linked_with_one():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, n).astype(np.uint32)).tobytes() for n in (1, 17, 30, 30, 60, 60, 90)] + [b""]
    for x, percent in itertools.product(sets, (20, 50, 80)):
        assert lsh.linked_with(x, sets, percent, 32).tolist() == [lsh.linked(x, y, percent, 32) for y in sets]


def test_order_decides(spark):
    """Passages are found among neighbours: in a random order they are not."""
    rng = np.random.default_rng(1)
    right = np.sort(rng.integers(0, 1 << 20, (200, 1)), axis=0).repeat(10, axis=1).repeat(2, axis=0).astype(np.uint32)
    left, one = np.zeros((400, 4), dtype=np.uint32), np.ones(400, dtype=np.int64)
    found = lambda at: windows.decide(0 * one, right[at], left, np.stack([np.arange(400), 0 * one, 0 * one], axis=1), 0 * one, 0 * one, 10)[0].sum()
    assert found(np.arange(400)) == 200 and found(rng.permutation(400)) < 20


def test_repeats_beyond_the_first_copy(spark):
    """Two documents share 60 words; a third, before them, holds only 21 to 40 of those: the 60 words are found all the same."""
    shared = prose(50, 60).split(" ")
    for a, n in ((0, 21), (10, 40), (25, 30)):
        rows = [(1, f"{prose(51, 40)} {' '.join(shared[a : a + n])} {prose(52, 40)}"), (2, f"{prose(53, 30)} {' '.join(shared)} {prose(54, 20)}"), (3, f"{prose(55, 25)} {' '.join(shared)} {prose(56, 20)}")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        for op in (op1, op2):
            assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in op.repeated_spans(df).collect()] == [(3, 25, 85, 2)], (op, a)


def test_unlike_texts_of_one_id(spark):
    """Places of one text are not read in another text of the same doc_id."""
    passage = prose(60, 55)
    rows = [(1, f"{prose(61, 30)} {passage}"), (2, f"{prose(62, 70)} {passage} {prose(63, 9)}"), (2, prose(64, 90)), (2, passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tags = {(r.doc_id, r.tag): len(plain_words(r.text)) for r in op2.tagged(df).collect()}
    for op in (op1, op2):
        got = {(r.doc_id, tags[r.doc_id, r.tag], r.start_word, r.end_word) for r in op.repeated_spans(df).collect()}
        assert got == {(2, 134, 70, 125), (2, 55, 0, 55)}


def test_suffixes_of_many_copies(spark):
    """One 55-word passage in 1,000 documents of different surroundings: all copies but the first are reported, whole."""
    passage, ids = prose(8, 55), random.Random(9).sample(range(10**6), 1000)
    at = {i: random.Random(i).randint(0, 30) for i in ids}
    around = lambda i, n, side: " ".join(f"{side}{i}w{j}" for j in range(n))
    rows = [(i, f"{around(i, at[i], 'b')} {passage} {around(i, 10 + i % 7, 'a')}") for i in ids]
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in op2.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(i, at[i], at[i] + 55, min(ids)) for i in ids if i != min(ids)}


def test_media(docs, none):
    texts = {}
    for i, t, *_ in corpus():
        texts.setdefault(i, []).append(t or "")
    got = op3.media_features(op3.to_media(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        raws = [t.encode() for t in texts[r.doc_id]]
        padded = {hashlib.sha256(p).hexdigest(): (len(b), len(p), zlib.crc32(p[-64:])) for b in raws for p in [b + bytes(-len(b) % 64 if b else 64)]}
        assert padded[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32)
    assert op3.media_features(op3.to_media(none)).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    for bpp, kind in ((1, 0), (3, 2), (4, 6)):
        samples = rng.integers(0, 256, (5, 7 * bpp), dtype=np.uint8)
        lines = bytearray()
        for y in range(5):  # a filter each, written plainly
            lines.append(y)
            for x in range(7 * bpp):
                a = int(samples[y, x - bpp]) if x >= bpp else 0
                b = int(samples[y - 1, x]) if y else 0
                c = int(samples[y - 1, x - bpp]) if y and x >= bpp else 0
                paeth = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))
                lines.append((int(samples[y, x]) - (0, a, b, (a + b) // 2, paeth)[y]) % 256)
        head = (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
        half = zlib.compress(bytes(lines))
        media = op3._SIGNATURE + op3._chunk(b"IHDR", head) + op3._chunk(b"tEXt", b"x") + op3._chunk(b"IDAT", half[:9]) + op3._chunk(b"IDAT", half[9:]) + op3._chunk(b"IEND", b"")
        assert np.array_equal(op3.decode(media), samples)
        for i in (3, 20, len(media) // 2, len(media) - 5):
            broken = bytearray(media)
            broken[i] ^= 1
            with pytest.raises((ValueError, zlib.error)):
                op3.decode(bytes(broken))
        with pytest.raises(ValueError):
            op3.decode(media[:-6])


def plain_omh(text):
    """Order MinHash restated with dictionaries over the same hashes."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    seen, buckets = {}, {}
    for at, h in enumerate((H.kmers(codes, op4.K) >> np.uint64(20)).tolist()):
        n = seen[h] = seen.get(h, -1) + 1
        v = int(H.mix(np.array([(h * 0x9E3779B97F4A7C15 + n) % 2**64], dtype=np.uint64))[0])
        buckets.setdefault(v >> 58, []).append((v, at))
    out = np.zeros(op4.SKETCHES, dtype=np.uint16)
    for b, items in buckets.items():
        two = [v for v, _ in sorted(sorted(items)[:2], key=lambda x: x[1])]
        m = lambda x: int(H.mix(np.array([x % 2**64], dtype=np.uint64))[0])
        out[b] = (m(two[0] + m(two[1])) if len(two) == 2 else m(two[0])) >> 48 | 1
    return out


def test_order_minhash(docs, none):
    for t in ("", "a", "abcdefgh" * 9, prose(1, 40), prose(2, 2000)):
        assert np.array_equal(op4.sketch(t), plain_omh(t))
    t = prose(7, 400)
    turned = " ".join(t.split(" ")[200:] + t.split(" ")[:200])
    assert op4.likeness(op4.sketch(t), op4.sketch(edit(t, 1, 0.01))) > 0.6 > op4.likeness(op4.sketch(t), op4.sketch(turned))
    rows = [(i, t or "") for i, t, *_ in corpus() if i is not None]
    rows = sorted(set(rows), reverse=True)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in op4.fingerprints(unique).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        s, se, sn = op4.sketch(t), op4.sketch(e), op4.sketch(following)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (op4.shown(s), op4.shown(se))
        assert (got[i].near_edited, got[i].near_next) == (op4.likeness(s, se), op4.likeness(s, sn))
    assert op4.fingerprints(docs).count() == docs.count()
    assert op4.fingerprints(none).count() == 0


def test_pfair_schedule():
    for w in ({"a": 1.0}, {"a": 5, "b": 3, "c": 1}, {str(i): i + 1.0 for i in range(30)}, {"a": 1000, "b": 1}):
        share = op5.shares(w, 200)
        assert sum(share.values()) == 200 and min(share.values()) >= 1
        plan = op5.schedule(share, 200)
        done = dict.fromkeys(w, 0)
        for k, i, slot in plan:
            assert done[k] == i
            done[k] += 1
            for s in w:
                assert abs(done[s] - share[s] / 200 * (slot + 1)) < 1
    with pytest.raises(ValueError):
        op5.shares({str(i): 1.0 for i in range(9)}, 8)


def test_mixing(spark, docs, none):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("source"))
    got = op5.mix_order(many, block=8, range_rows=100).orderBy("slot", "place").collect()
    assert len({(r.slot, r.place) for r in got}) == 3000 and {r.doc_id for r in got} == set(range(3000))
    n = {"hot": 2100, "b": 600, None: 300}
    share = op5.shares({"+hot": 2100**0.5, "+b": 600**0.5, "-": 300**0.5})
    done = dict.fromkeys(n, 0)
    for slot, rows in itertools.groupby(got, key=lambda r: r.slot):
        rows = list(rows)
        assert len({r.source for r in rows}) == 1
        done[rows[0].source] += 1
        if all(r.in_mix for r in rows):
            assert len(rows) == 8 or done[rows[0].source] * 8 > n[rows[0].source]
            for s in n:
                assert abs(done[s] - share["-" if s is None else "+" + s] / 1000 * (slot + 1)) < 1
    assert op5.mix_order(docs).count() == docs.count()
    out = op5.mixed(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert op5.mix_order(none).count() == 0 and op5.mixed(none).count() == 0


def unigram_library():
    """The library's unigram encoder with the vocabulary's scores."""
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(op6.TOKENIZER, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    floor = min(p.score for p in m.pieces if p.score > -1e8) - 10
    for p in m.pieces:
        p.score = max(p.score, floor)
    return sp.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_token_counts(docs, none):
    """Whole texts, of words and lines, equal the library's counts."""
    own = unigram_library()
    want = {}
    for i, t, *_ in corpus():
        want.setdefault(i, set()).add(len(own.encode(t or "")))
    got = op6.token_counts(docs).collect()
    assert len(got) == docs.count() and all(r.n_tokens in want[r.doc_id] for r in got)
    assert op6.token_counts(none).count() == 0
    count = op6.Counter(L.Vocabulary.read(op6.TOKENIZER))
    texts = ["ab" * 700, "\n\n  a\n", prose(3, 400).replace(" ", ""), "é🎉" * 300, prose(9, 2000)]
    assert count(texts)[0].tolist() == [len(own.encode(t)) for t in texts]


def test_all_matches():
    """The automaton finds every occurrence of every piece, in short units and over lanes of long ones."""
    vocab = L.Vocabulary.read(op6.TOKENIZER)
    named = set(vocab.pieces)
    text = " the cats" + " " + "".join(random.Random(1).choice("abcdeé") for _ in range(900))
    b, starts, ends, _ = L.units([text])
    heads = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    got = {(int(a), int(z)) for found in L.matches(vocab, b, heads) for a, z, _ in zip(*found, strict=True)}
    raw = b.tobytes()
    want = {(i, j) for lo, hi in zip(heads, heads[1:], strict=False) for i in range(lo, hi) for j in range(i + 1, min(hi, i + 60) + 1) if raw[i:j] in named}
    assert got == want and len(want) > 1000


def test_vocabularies_that_break_the_units(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for piece in ("a▁b", "a\nb", None):
        m = pb.ModelProto()
        with open(op6.TOKENIZER, "rb") as f:
            m.ParseFromString(f.read())
        if piece:
            m.pieces.add(piece=piece, score=-1.0)
        else:
            m.normalizer_spec.remove_extra_whitespaces = True
        (tmp_path / "m.model").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            L.Vocabulary.read(str(tmp_path / "m.model"))


def all_segmentations(vocab, text, theta):
    b = (" " + text).encode().replace(b" ", bytes([L.SPACE]))
    score = dict(zip(vocab.pieces, vocab.scores, strict=True))
    out = {}

    def rec(i, path, s):
        if i == len(b):
            out[path] = s
        for j in range(i + 1, len(b) + 1):
            if b[i:j] in score:
                rec(j, (*path, b[i:j]), s + theta * score[b[i:j]])

    rec(0, (), 0.0)
    top = max(out.values())
    total = sum(math.exp(s - top) for s in out.values())
    return {k: math.exp(s - top) / total for k, s in out.items()}


def test_sampling_distribution():
    vocab = L.Vocabulary.read(op7.TOKENIZER)
    name = dict(zip(vocab.ids.tolist(), vocab.pieces, strict=True))
    for text, k in (("the cat", 3), ("aa", 3)):
        p = all_segmentations(vocab, text, op7.THETA)
        n = 4000
        second = {a: sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a) for a in p}
        seen = [dict.fromkeys(p, 0) for _ in range(2)]
        weight = 0.0
        for samples in op7.Encoder(vocab, k, op7.THETA)(np.arange(n), [text] * n):
            paths = [tuple(name[i] for i in ids.tolist()) for ids, _, _ in samples]
            assert len(set(paths)) == len(paths) == min(k, sum(x > 1e-12 for x in p.values()))
            for path, (_, log_p, _) in zip(paths, samples, strict=True):
                assert math.isclose(math.exp(log_p), p[path], rel_tol=1e-9)
            for j in range(2):
                seen[j][paths[j]] += 1
            weight += sum(math.exp(log_p - inc) for _, log_p, inc in samples)
        assert sum(abs(seen[0][a] / n - p[a]) for a in p) / 2 < 0.03
        assert sum(abs(seen[1][a] / n - second[a]) for a in p) / 2 < 0.03
        assert abs(weight / n - 1) < 0.03


def test_sampling(docs, none):
    got = op7.sample_segmentations(docs, k=3).collect()
    texts = {}
    for i, t, *_ in corpus():
        texts.setdefault(i, set()).add((t or "").replace("▁", " "))
    assert all(r.text in texts[r.doc_id] for r in got) and {r.doc_id for r in got} == set(texts)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text), []).append(tuple(r.ids))
    assert len(by[45, next(iter(texts[45]))]) == len(set(by[45, next(iter(texts[45]))])) == 3
    again = {(r.doc_id, r.sample, tuple(r.ids)) for r in op7.sample_segmentations(docs.repartition(7), k=3).collect()}
    assert again == {(r.doc_id, r.sample, tuple(r.ids)) for r in got}
    assert op7.sample_segmentations(none).count() == 0


def test_language(spark, none):
    words = {"en": "the and with that from this have was".split(), "de": "der und mit das von dies haben war".split()}
    rows = [(i, (lang, " ".join(random.Random(i).choices(words[lang], k=12)))) for i in range(300) for lang in [("en", "de")[i % 2]]]
    rows = [(i, t, lang, "s") for i, (lang, t) in rows] + [(1000, None, "en", "s"), (1001, "123 ...", "de", "s"), (1002, "", None, None), (None, "the and", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in op8.identify(df).collect()}
    assert len(got) == len(rows)
    for i, t, lang, _ in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert op8.identify(none).count() == 0
    assert {r.lang_pred for r in op8.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_empty_last(spark):
    model = {"langs": ["de", "en"], "table": np.random.default_rng(1).normal(size=(op8.BUCKETS, 2)), "accept": 0.5}
    schema = "doc_id bigint, text string, lang string"
    for last in (None, ""):
        for texts in ([last], ["the and", last], [last, "the and", last, last]):
            got = op8.identify(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], schema).coalesce(1), model).collect()
            alone = {r.doc_id: r for r in op8.identify(spark.createDataFrame([(1, "the and", None)], schema), model).collect()}[1]
            assert [(r.lang_pred, r.score) for r in sorted(got)] == [(alone.lang_pred, alone.score) if t else ("und", 0.0) for t in texts]


def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        text = prose(i, 60)
        if kind == 1:
            text = " ".join([*text.split(" ")[:30], "vileword", *text.split(" ")[30:]])
        if kind == 2:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "s", len(text)))
        if i < n // 2 or kind == 1 and i % 3 == 0:
            labels.append((i, int(kind != 2), int(kind == 1)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(spark, docs, none):
    rows, labels = labelled(spark)
    kept = {r.doc_id for r in op9.select_quality(rows, labels).collect()}
    for kind, low, high in ((0, 0.97, 1), (3, 0.97, 1), (1, 0, 0.05), (2, 0, 0.05)):
        of = [i for i in range(600) if i % 4 == kind]
        assert low <= len(kept & set(of)) / len(of) <= high
    scored = op9.graded_quality(docs, labels).collect()
    by_text = {}
    for r in scored:  # nulls, empties and repeated rows: equal texts, equal scores
        by_text.setdefault(r.text or "", set()).add(r["__quality"])
    assert len(scored) == docs.count() and all(len(v) == 1 for v in by_text.values())
    chosen = op9.select_quality(docs, labels)
    assert chosen.columns == docs.columns and chosen.count() == sum(r["__quality"].kept for r in scored)
    assert op9.select_quality(none, labels).count() == 0
    assert op9.select_quality(docs, labels.limit(0)).count() == docs.count()
    odd = spark.createDataFrame([(0, None, None), (None, 1, 0), (0, 1, 0), (0, 0, 0)], labels.schema)
    assert op9.graded(odd).collect()[0].grade == 1


def test_pipeline_keeps_the_mix(spark, tmp_path):
    """Read by (part, row), each prefix of the result holds the target shares within one block."""
    source = lambda i: "hot" if i % 10 < 7 else "b" if i % 10 < 9 else None
    texts = [(i, prose(i, 9), "en", source(i), 1) for i in range(1000)] + [(None, prose(5000, 9), "en", "b", 1)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    place = {(r.part, r.row): r.doc_id for r in got}
    ids = set(place.values())
    assert len(place) == len(ids) and None in ids and len({(r.doc_id, r.part, r.row) for r in got}) == len(ids)
    of = lambda i: "b" if i is None else source(i)
    n = {s: sum(of(i) == s for i in ids) for s in ("hot", "b", None)}
    share = op5.shares({"-" if s is None else "+" + s: c**op5.ALPHA for s, c in n.items()})
    done = dict.fromkeys(n, 0)
    # a slot is a whole block, as long as no source has come to its end
    order = [of(place[at]) for at in sorted(place)]
    slots = [order[i : i + op5.BLOCK] for i in range(0, len(order), op5.BLOCK)]
    full = next(i for i, x in enumerate(slots) if len(set(x)) > 1 or len(x) < op5.BLOCK)
    assert full > 5
    for slot in range(full):
        done[slots[slot][0]] += 1
        for s in n:
            assert abs(done[s] - share["-" if s is None else "+" + s] / op5.PERIOD * (slot + 1)) < 1


def test_likelihood_of_the_cumulative_link():
    """The fit's thresholds are ordered, and its weights lower the plainly restated loss against none."""
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 300)
    rows = [np.array([0, 100 + g, 200 + int(rng.integers(0, 5))]) for g in grades]
    model = op9.fit(rows, grades)
    cuts = model["cuts"]
    assert cuts[0] < cuts[1]

    def loss(w):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            p = [1.0, *(1 / (1 + math.exp(-(float(w[r].sum()) - c))) for c in cuts), 0.0]
            total -= math.log(max(p[g] - p[g + 1], 1e-12))
        return total / len(rows)

    assert loss(model["w"]) < 0.5 * loss(np.zeros_like(model["w"]))
    expected = op9.score(model, pd.Series(["x"]))
    assert 0 <= expected.p_top[0] <= expected.p_not_lowest[0] <= 1 and math.isclose(expected.expected_grade[0], expected.p_top[0] + expected.p_not_lowest[0])


def plain_language(model, text):
    """The prediction restated: average of the logits of all hashed 2- to 4-grams, softmax."""
    raw = [c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in (" " + text.lower() + " ").encode()]
    z, n = np.zeros(len(model["langs"])), 0
    for i in range(len(raw)):
        for size in (2, 3, 4):
            if i + 1 >= size and not (raw[i] == 32 and raw[i - 1] == 32):
                acc = sum(raw[i - j] << (8 * j) for j in range(size))
                bucket = ((acc ^ ((size - 1) * 0x9E3779B9 & 0xFFFFFFFF)) * 2654435761 & 0xFFFFFFFF) >> 17
                if bucket:
                    z, n = z + model["table"][bucket], n + 1
    p = np.exp(z / max(n, 1) - (z / max(n, 1)).max())
    return model["langs"][int(p.argmax())], float((p / p.sum()).max())


def test_language_prediction_restated(spark):
    model = {"langs": ["de", "en", "fr"], "table": np.random.default_rng(2).normal(size=(op8.BUCKETS, 3)), "accept": 0.4}
    model["table"][0] = 0
    texts = ["the cat", "Über  alles, 12!", "a", prose(3, 50), "The The"]
    got = {r.doc_id: r for r in op8.identify(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"), model).collect()}
    for i, t in enumerate(texts):
        lang, score = plain_language(model, t)
        assert got[i].lang_pred == lang and math.isclose(got[i].score, score, rel_tol=1e-4) and got[i].accepted == (score >= 0.4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = op8.op8_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert right.where("lang = lang_pred").count() >= 0.95 * right.count()


def test_png_round_trip():
    """Any samples come back from their stored form."""
    samples = np.random.default_rng(6).integers(0, 256, (64, 64)).astype(np.uint8)
    text_bytes = samples.tobytes()
    assert np.array_equal(op3.decode(op3.encode(text_bytes)), samples)


def test_very_long_texts(spark):
    """32,768 characters without a space, and 2**15 words: every operator that reads texts gives a row."""
    solid, wide = "ab" * (1 << 14), prose(11, 1 << 15)
    df = spark.createDataFrame([(1, solid, "en", "a", 1), (2, wide, "en", "a", 1), (3, wide, "en", None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    near = {r.doc_id: r.component_id for r in op10.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 2, 3: 2}
    spans = {r.doc_id: (r.start_word, r.end_word) for r in op1.repeated_spans(df).collect()}
    assert spans == {3: (0, 1 << 15)}
    assert {r.doc_id: (r.start_word, r.end_word) for r in op2.repeated_spans(df).collect()} == {3: (0, 1 << 15)}
    assert op9.graded_quality(df, spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int")).where("__quality.kept is not null").count() == 3
    assert {r.doc_id: r.text for r in op7.sample_segmentations(df, k=1).collect()} == {1: solid, 2: wide, 3: wide}
    counts = {r.doc_id: r.n_tokens for r in op6.token_counts(df).collect()}
    assert counts[2] == counts[3] > 1 << 15 and counts[1] == len(unigram_library().encode(solid))
    assert op5.mix_order(df).count() == op8.identify(df).count() == op3.media_features(op3.to_media(df)).count() == op4.fingerprints(df).count() == 3


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows, unlike texts of one doc_id, clashing columns; then an empty table."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, __kept_id string"
    rows = [(1, prose(1, 60)), (1, prose(1, 60)), (1, prose(2, 60)), (2, prose(1, 60)), (3, None), (4, ""), (None, prose(1, 60)), (None, None), (5, "one")]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for name, given in (("odd", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame([(i, t, None, None, 0, "x", "y") for i, t in given], kind).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        got = sorted({(r.doc_id or 0, r.text) for r in corpus_pipeline.run(spark, at).collect()})
        want = {(1, prose(1, 60)), (1, prose(2, 60)), (3, ""), (4, ""), (0, prose(1, 60)), (0, ""), (5, "one")} if given else set()
        assert got == sorted(want)


def test_pipeline(spark, tmp_path):
    rows, labels = labelled(spark)
    copies = rows.where("doc_id % 8 = 0").withColumn("doc_id", F.col("doc_id") + 10000)
    passage = prose(77, 60)
    shared = rows.where("doc_id % 40 = 3").withColumn("text", F.concat("text", F.lit("\n" + passage)))
    all_docs = rows.join(shared.select("doc_id"), "doc_id", "left_anti").union(shared).union(copies)
    all_docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, None
        docs = stage(spark, before, str(tmp_path))
        assert docs.columns == before.columns
        docs.write.parquet(str(tmp_path / n))
        docs = spark.read.parquet(str(tmp_path / n))
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert max(ids) < 10000 and sum(passage in r.text for r in docs.collect()) == 1
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ids and names[0] == "quality"
    # documents read by (part, row) stand in the order of the mix
    placed = [r.doc_id for r in op5.mix_order(docs).orderBy("slot", "place").collect()]
    assert [i for i, _ in itertools.groupby(r.doc_id for r in sorted(got, key=lambda r: (r.part, r.row)))] == placed


def test_any_column_name(spark):
    """No column of the caller is renamed or lost by a filtering stage."""
    rows = [(i, prose(i, 30), "a", "b", "c") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __own string, __quality string, p_top string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    kept = op9.select_quality(docs, labels, keep_from=0.0)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows
    assert sorted(map(tuple, op9.select_quality(docs, labels.limit(0)).collect())) == rows


def test_null_ids_are_spread(spark):
    """Rows without doc_id go to many ranges of the fingerprints and of the mix, and keep their neighbours."""
    docs = spark.createDataFrame([(None if i % 2 else i, f"text {i} " + prose(i, 5), "s") for i in range(400)], "doc_id bigint, text string, source string")
    sizes = [r["count"] for r in op4._ranged(docs).where("not __halo").groupBy("__range").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 120
    got = op4.fingerprints(docs).collect()
    assert len(got) == 400 and sum(r.doc_id is None for r in got) == 200
    mix = op5.mix_order(docs, block=8, range_rows=50).collect()
    assert len({(r.slot, r.place) for r in mix}) == 400


def test_every_language_is_learned(spark):
    """However many languages there are, each has rows to learn from."""
    rows = [(n, f"{prose(n % 30, 3)} w{n % 30}", f"l{n % 30:02d}") for n in range(300)]
    model = op8.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_lang=3, max_rows=20)
    assert len(model["langs"]) == 30
