"""Frames, memories, weighted similarity, components, weighted draws and user aggregates against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_up
from tidemark.operators import dataset, folds, images, memory
from tidemark.operators.aggregates import aggregate


def scenes_plain(rows, width, threshold, min_length, frequency, given):
    """The rules one after another, from a list of (n, hit, luma, frame, ratio, reason)."""
    out, kept = [], None
    for n, hit, y, gray, ratio, reason in rows:
        if not (hit or n == 0):
            out.append((n, False, 0))
            continue
        if kept is None:
            kept = (n, gray, y, reason or 0)
            out.append((n, True, 1))
            continue
        last, old, luma, before = kept
        soon = n - last < min_length
        if soon and min_length > 1 and n > 1 and luma >= 0.19 > y:
            out.append((n, False, -1))
            continue
        a, b = (g.reshape(1, -1, width).astype(float) for g in (gray, old))
        s = round_half_up(float(images.ssim(a, b)[0]))
        h, k = (np.bincount(g, minlength=256) for g in (gray, old))
        near = round_half_up(1 - math.sqrt(max(0, 1 - sum(math.sqrt(float(i * j)) for i, j in zip(h, k)) / len(gray))))
        rule = 0
        if given and (reason or 0) > 1 and before < 2:
            change, code = 0.1 < y < 0.7, 4 * soon
        else:
            if s < threshold and near < 0.95:
                rule = 1 if 0.1 < y < 0.7 and not (not soon and frequency > 1 and y < 0.14 and ratio < 2) else 0
            elif s >= 0.69 and luma < 0.19 <= y:
                rule = 2 if 0.1 < y < 0.7 else 0
            elif s >= 0.69 and near < 0.7:
                rule = 3 if 0.19 < y < 0.7 else 0
            change, code = rule > 0, rule + 4 * soon
        out.append((n, change, code if change else 0))
        if change:
            kept = (n, gray, y, reason or 0)
    return out


@pytest.mark.parametrize("min_length, frequency, given", [(1, 0, False), (3, 4, False), (4, 0, True)])
def test_scene_frames(spark, min_length, frequency, given):
    rng = np.random.default_rng(2)
    rows = []
    for clip in range(3):
        base = rng.integers(0, 256, 120)
        for n in range(90):
            if n % 7 == 0:
                base = rng.integers(0, 256, 120) // (1 + n % 3)
            gray = np.clip(base + rng.integers(-3, 4, 120) + (40 if n % 11 == 0 else 0), 0, 255).astype(np.uint8)
            rows.append((clip, n, bool(rng.random() < 0.6), float(rng.choice([0.05, 0.12, 0.18, 0.3, 0.5, 0.8])), gray.tobytes(), float(rng.choice([1.0, 3.0])), int(rng.integers(0, 4))))
    df = spark.createDataFrame(rows, "clip_id long, n long, hit boolean, luma double, frame binary, ratio double, reason long").repartition(4)
    out = folds.filter_scenes(df, "hit", "luma", "frame", 12, 0.55, min_length, frequency=frequency, ratio="ratio", reason="reason" if given else None).collect()
    codes = set()
    for clip in range(3):
        want = scenes_plain([(n, h, y, np.frombuffer(f, np.uint8), q, k) for c, n, h, y, f, q, k in rows if c == clip], 12, 0.55, min_length, frequency, given)
        assert sorted((r.n, r.change, r.why) for r in out if r.clip_id == clip) == want
        codes |= {k for _, _, k in want}
    assert len(codes) >= (3 if min_length == 1 else 4)


def test_memory_contents(spark):
    rng = np.random.default_rng(4)
    rows = [(0, n, rng.normal(size=6).tolist(), rng.normal(size=3).tolist(), float(1 + rng.random()), rng.random(6).tolist()) for n in range(200)]
    df = spark.createDataFrame(rows, "clip_id long, n long, key array<double>, value array<double>, shrink double, pick array<double>").repartition(3)
    got = folds.remember(df, "key", "value", "shrink", "pick", every=2, most=9, least=4, protos=2, long_most=7, top=5).orderBy("n").collect()
    work, long = [], []  # dictionaries, one number after another

    def alike(e, key, pick):
        return -sum(p * (a - b) ** 2 for a, b, p in zip(e["key"], key, pick)) * e["shrink"] / math.sqrt(len(key))

    for r, (_, n, key, value, shrink, pick) in zip(got, rows):
        held = long + work
        read = None
        if held:
            scores = [alike(e, key, pick) for e in held]
            best = sorted(range(len(held)), key=lambda i: (-scores[i], i))[:5]
            total = sum(math.exp(scores[i]) for i in best)
            read = [sum(math.exp(scores[i]) / total * held[i]["value"][j] for i in best) for j in range(3)]
            for i, e in enumerate(held):
                e["use"] += math.exp(scores[i]) / total if i in best else 0
                e["life"] += 1
        if n % 2 == 0:
            work.append({"key": key, "value": value, "shrink": shrink, "pick": pick, "use": 0.0, "life": 1e-7})
            if len(work) == 9:
                middle, work = work[1:6], work[:1] + work[6:]
                protos = sorted(range(5), key=lambda i: (-middle[i]["use"] / middle[i]["life"], i))[:2]
                long = sorted(sorted(long, key=lambda e: -e["use"] / e["life"])[:5], key=long.index)
                for p in protos:
                    w = [math.exp(alike(e, middle[p]["key"], middle[p]["pick"])) for e in middle]
                    w = [x / sum(w) for x in w]
                    long.append({"key": middle[p]["key"], "value": [sum(x * e["value"][j] for x, e in zip(w, middle)) for j in range(3)],
                                 "shrink": sum(x * e["shrink"] for x, e in zip(w, middle)), "use": 0.0, "life": 1e-7})
        assert (r.work, r.long) == (len(work), len(long))
        assert (read is None and r.read is None) or r.read == pytest.approx(read)
        assert r.usage == pytest.approx([e["use"] for e in long + work])
    assert len(long) == 7


def test_selective_similarity(spark):
    rng = np.random.default_rng(6)
    q, e, k, s = rng.normal(size=(7, 5)), rng.random((7, 5)), rng.normal(size=(90, 5)), 1 + rng.random(90)
    k[3] = k[4]
    s[3] = s[4]
    queries = spark.createDataFrame([(i, q[i].tolist(), e[i].tolist()) for i in range(7)], "id long, vector array<double>, selection array<double>")
    keys = spark.createDataFrame([(i, k[i].tolist(), float(s[i])) for i in range(90)], "id long, vector array<double>, shrinkage double")
    scores = -(((k[None] - q[:, None]) ** 2) * e[:, None]).sum(2) * s[None] / math.sqrt(5)
    got = {(r.query_id, r["rank"]): (r.key_id, r.score) for r in memory.selective_top_k(queries, keys, 8).collect()}
    for i in range(7):
        for r, j in enumerate(np.argsort(-scores[i], kind="stable")[:8], 1):
            assert got[i, r][1] == pytest.approx(scores[i, j]) and (got[i, r][0] == j or {got[i, r][0], j} == {3, 4})


def test_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "id long, v array<double>").repartition(5)
    mean, ways, variances = memory.principal_components(df, "v", 3)
    _, sizes, want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert mean == pytest.approx(x.mean(0)) and variances == pytest.approx(sizes[:3] ** 2 / 399)
    assert np.abs((ways * want[:3]).sum(1)) == pytest.approx(np.ones(3))
    out = memory.project(df.where("id < 3"), "v", mean, ways).orderBy("id").collect()
    assert np.array([r.projected for r in out]) == pytest.approx((x[:3] - mean) @ ways.T)
    assert memory.principal_components(df.limit(0), "v", 2)[1].size == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_weighted_draws(spark, parts):
    rows = [(i, 100_000 if i == 50 else 0 if i % 10 == 0 else i % 7 + 1, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, weight long, at string").repartition(parts)
    out = dataset.weighted_draws(df, "weight", 20_000, 3, "id").collect()
    assert sorted(r.draw for r in out) == list(range(20_000))
    total = sum(w for _, w, _ in rows)
    seen = collections.Counter(r.id for r in out)
    for i, w, _ in rows:
        p = w / total
        assert abs(seen[i] - 20_000 * p) <= 6 * math.sqrt(20_000 * p * (1 - p)) + (6 if p else 0)
    again = dataset.weighted_draws(df.repartition(3), "weight", 20_000, 3, "id").collect()
    assert sorted((r.draw, r.id) for r in out) == sorted((r.draw, r.id) for r in again)
    assert dataset.weighted_draws(df.limit(0), "weight", 5, 3, "id").count() == 0


def test_user_aggregates(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("double").alias("x")).repartition(7)
    out = aggregate(df, ["k", "g"], ["x"], list, lambda s, p: sorted([*s, *p["x"].tolist()])[-3:], lambda a, b: sorted([*a, *b])[-3:], lambda s: {"low": s[0], "n": len(s)}, {"low": "double", "n": "long"})
    want = collections.defaultdict(list)
    for r in df.collect():
        want[r.k, r.g].append(r.x)
    assert {(r.k, r.g): (r.low, r.n) for r in out.collect()} == {key: (sorted(v)[-3], 3) for key, v in want.items()}
    assert aggregate(df.limit(0), ["k"], ["x"], list, lambda s, p: s, lambda a, b: a, lambda s: {"n": 0}, {"n": "long"}).count() == 0
