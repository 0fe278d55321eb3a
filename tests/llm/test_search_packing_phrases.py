"""Ranked search, packing along a curve and phrase collocations against plain versions, on awkward rows too."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, packing, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, score double, rank int, block long, row long, n long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, 1, 2, 3, 4) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "of", "Straße", "naïve", "世界", "x1", "Über", *["".join(rng.choice("aeioklmnrst") for _ in range(4)) for _ in range(60)]]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((8, 30, 67))]) + rng.choice(["", "", "", ".", ",", "\n", "\t", "!?"]) for _ in range(n))
    out = [(k, text(rng.choice((1, 5, 40, 200))), rng.choice(("en", "fr"))) for k in range(150)]
    out += [(200 + k, "the of the of new york city. New York City", "en") for k in range(60)]
    out += [(7, out[7][1], "fr"), (7, "other words of 7", None), (None, out[3][1], "en"), (None, None, None), (300, None, "en"), (301, "", "en"), (302, " .. !", "und")]
    return [*out, (303, text(40_000), "en"), (304, "a\x00b \x1f\x85  x y", None), (305, "k" * 30_000, "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


# ---- ranked search


def ranked_plain(rows, items, k=10):
    found = [(i, collections.Counter(TERM.findall((t or "").translate(FOLD)))) for i, t, *_ in rows]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    total, df = sum(n for _, _, n in found), collections.Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(found) + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = collections.defaultdict(set)
    for item, text in items:
        queries[item] |= set(TERM.findall((text or "").translate(FOLD)))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, c, n in found:
            m = 10 + 90 * n * len(found) // total
            scores.append((sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c), i))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "the of"), (2, "STRASSE Straße naïve new"), (3, None), (4, ""), (5, "nowhere zzz9"), (6, "York city York"), (6, "world 世界"), (7, "a b x y über ÜBER"), (None, "x1 the")]


@pytest.mark.parametrize("documents, seeds, terms", [(128, 4, 200_000), (3, 1, 4), (1, 2, 200_000)])
def test_search(spark, docs, rows, documents, seeds, terms):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, query long, rank int").repartition(3)
    index = ranked_search.build(docs, documents)
    got = sorted((tuple(r) for r in ranked_search.search(index, items, seeds=seeds, query_terms=terms).collect()), key=repr)
    assert got == ranked_plain(rows, ITEMS)


def test_blocks_below_the_threshold_are_not_scored(spark):
    """Blocks without rare words of the query have bounds below what the best blocks give."""
    from unittest import mock

    q = ranked_search._Queries([[b"rare", b"the"]])
    q.weight[:] = [5000, 1]
    best = ranked_search._Best(np.zeros(1, np.int64), 2)
    best.add(np.array([[9_000_000], [8_000_000], [7]]), [1, 2, None])
    best.settle()
    assert best.floor.tolist() == [8_000_000] and best.rows.shape[1] == 2
    assert q.bounds(np.array([1, -1]), np.array([10**6, 10**6])).tolist() == [10**6]  # below 8,000,000
    with mock.patch.object(ranked_search._Queries, "scores", side_effect=AssertionError):
        assert not (q.bounds(np.array([1]), np.array([10**6])) >= best.floor).any()


def test_search_without_rows(spark, docs):
    none, some = make(spark, []), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search.digest(none, some).count() == 0
    assert ranked_search.digest(docs, some.limit(0)).count() == 0
    assert ranked_search.digest(docs.where("text is null"), some).count() == 0


# ---- packing


def test_hilbert_curve():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(side**dims))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # each step goes to a neighbour


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, _ in rows]
    out = packing.pack(docs, digest=True).collect()
    assert sum(r.length for r in out) == sum(len(x) for _, x in ids)
    fill = collections.Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id] and r.length > 0
        fill[r.sequence_id] += r.length
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == 1024 for s in range(len(fill) - 1))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    for (i, start, length, c, n), _ in pieces.items():
        assert any(j == i and len(x) == n and crc(x[start : start + length]) == c for j, x in ids)
    by = collections.Counter()
    for (i, _, length, _, n), k in pieces.items():
        by[i, n] += length * k
    assert all(v % n == 0 for (_, n), v in by.items())


def test_sequences_hold_the_stream(spark, docs):
    pieces = packing.pack(docs, length=256).cache()
    whole = packing.sequences(pieces, 256).collect()
    last = max(r.sequence_id for r in whole)
    assert all(len(r.ids) == 1024 for r in whole if r.sequence_id < last)
    got = {r.sequence_id: bytes(r.ids)[: 4 * r.n_tokens] for r in whole}
    for r in pieces.collect():
        assert got[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(make(spark, []), digest=True).count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    rng = random.Random(5)
    topics = [[f"{a}{k}" for k in range(40)] for a in ("alpha", "beta", "gamma", "delta")]
    rows = [(k, " ".join(rng.choice(topics[k % 4]) for _ in range(300)), "en") for k in range(80)]
    out = packing.pack(make(spark, rows).repartition(7), digest=True).where("start = 0").orderBy("sequence_id", "offset").collect()
    order = [r.doc_id % 4 for r in out]
    assert sum(a == b for a, b in zip(order, order[1:])) >= 60  # by chance about 20


# ---- phrases


def phrases_plain(rows, least=10, covered=50, best=2000):
    n, f = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        longer = [b for (g, q), b in found.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        s, _, x, y = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), x, y))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:best], 1))


@pytest.mark.parametrize("shard, bits", [(4_000_000, 1 << 26), (300, 1 << 15)])
def test_collocations(spark, docs, rows, monkeypatch, shard, bits):
    monkeypatch.setattr(collocations.bitmaps, "__defaults__", (shard, 3 * shard))
    monkeypatch.setattr(collocations.pair_table, "__defaults__", (bits,))
    assert sorted(tuple(r) for r in collocations.digest(docs).collect()) == phrases_plain(rows)


def test_longer_phrases(spark, docs, rows):
    f = collections.Counter()
    for _, t, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, " ".join(w[i : i + 4])) for i in range(len(w) - 3))
    shards = collocations.bitmaps(docs, 2000)
    everything = b"\xff" * 4096
    got = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(shards, 4, everything).collect()}
    assert got == f


def test_batches_hold_all_words(rows, monkeypatch):
    made = collocations._shard("en", [t.encode() for _, t, _ in rows if t]).to_pylist()[0]
    s = collocations._Shard("en", made["words"], made["bitmaps"])
    whole = [(0, len(s.word))]
    assert [(x.start, x.stop) for x in s.batches()] == whole
    monkeypatch.setattr(collocations, "BATCH", 5)
    parts = [(x.start, x.stop) for x in s.batches()]
    assert len(parts) > 20 and parts[0][0] == 0 and parts[-1][1] == len(s.word) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_segments_end_with_pieces():
    text = b"aa bb. cc dd, " * 500
    with_defaults = list(collocations._segments(text))
    assert b"".join(with_defaults) == text
    from unittest import mock

    with mock.patch.object(collocations, "SEGMENT", 50):
        parts = list(collocations._segments(text))
        assert b"".join(parts) == text and len(parts) > 100 and all(p[-1:] in b".," for p in parts[:-1])
        assert list(collocations._segments(b"x" * 500)) == [b"x" * 500]
    row = collocations._shard("en", [b"", b" .. "])
    assert row is None and isinstance(collocations._shard("en", [b"a"]), pa.RecordBatch)


def test_phrases_without_rows(spark):
    assert collocations.digest(make(spark, [])).count() == 0
    assert collocations.digest(make(spark, [(1, None, None), (2, ". .", "en")])).withColumn("x", F.lit(1)).count() == 0
