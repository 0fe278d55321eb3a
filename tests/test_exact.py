"""Operators without SQL against plain versions, and both ways of operators that choose by size."""

import html
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dataset, images, memory, ranking, tabular, temporal, text

SIDE = 8


@pytest.fixture(scope="module")
def stack(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 256, 64).tolist(), rng.integers(0, 256, 64).tolist()) for i in range(12)]
    rows += [(100, [7] * 64, [7] * 64), (101, list(range(64)), list(range(64)))]
    return rows, spark.createDataFrame(rows, "frame_id long, a array<long>, b array<long>")


def at(x, r, c):
    return x[min(SIDE - 1, max(0, r)) * SIDE + min(SIDE - 1, max(0, c))]


def test_ssim_by_loops(stack):
    rows, df = stack
    got = {r.frame_id: r.ssim for r in images.ssim_series(df).collect()}
    for i, a, b in rows:
        total = []
        for r in range(2):
            for c in range(2):
                x = [at(a, r + j, c + k) for j in range(7) for k in range(7)]
                y = [at(b, r + j, c + k) for j in range(7) for k in range(7)]
                mx, my = sum(x) / 49, sum(y) / 49
                vx, vy = sum((v - mx) ** 2 for v in x) / 48, sum((v - my) ** 2 for v in y) / 48
                cov = sum((v - mx) * (w - my) for v, w in zip(x, y)) / 48
                c1, c2 = 2.55**2, 7.65**2
                total.append((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2)))
        assert abs(got[i] - sum(total) / 4) <= 1e-4


def test_edges_by_loops(stack):
    rows, df = stack
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    got = {r.frame_id: r.v for r in images.edges(df).collect()}
    for i, a, _ in rows:
        want = []
        for r in range(SIDE):
            for c in range(SIDE):
                around = [at(a, r + y, c + x) for y, x in ring]
                responses = [abs(sum(around[(t + k) % 8] * (5 if k < 3 else -3) for k in range(8))) for t in (0, 2, 4, 6)]
                want.append(min(255, max(responses)))
        assert got[i] == want


def test_retinex_by_loops(stack):
    rows, df = stack
    got = {r.frame_id: r.v for r in images.retinex(df).collect()}

    def blurred(a, sigma):
        n = max(1, int(3 * sigma))
        k = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-n, n + 1)]
        k = [x / sum(k) for x in k]
        down = [sum(w * at(a, r + d, c) for w, d in zip(k, range(-n, n + 1))) for r in range(SIDE) for c in range(SIDE)]
        return [sum(w * at(down, r, c + d) for w, d in zip(k, range(-n, n + 1))) for r in range(SIDE) for c in range(SIDE)]

    for i, a, _ in rows:
        scales = [blurred(a, s) for s in (1.0, 2.0, 4.0)]
        m = [sum(math.log(v + 1) - math.log(s[j] + 1) for s in scales) / 3 for j, v in enumerate(a)]
        spread = max(m) - min(m)
        want = [(x - min(m)) / spread * 255 if spread > 1e-9 else 0 for x in m]
        if spread > 1e-9:
            assert all(g == int(w) or abs(w - round(w)) < 1e-6 for g, w in zip(got[i], want))


def test_clahe_by_loops(stack):
    rows, df = stack
    got = {r.frame_id: r.v for r in images.clahe(df, clip=40.0).collect()}
    for i, a, _ in rows:
        tables = {}
        for ty in range(2):
            for tx in range(2):
                h = [0.0] * 256
                for r in range(4):
                    for c in range(4):
                        h[at(a, 4 * ty + r, 4 * tx + c)] += 1
                top = max(1, int(40.0 * 16 / 256))
                over = sum(max(0.0, x - top) for x in h)
                run, table = 0.0, []
                for x in h:
                    run += min(x, top) + over / 256
                    table.append(min(255, max(0, math.floor(run * 255 / 16 + 0.5))))
                tables[ty, tx] = table
        want = []
        for r in range(SIDE):
            for c in range(SIDE):
                y, x, v = (r + 0.5) / 4 - 0.5, (c + 0.5) / 4 - 0.5, at(a, r, c)
                y0, x0 = math.floor(y), math.floor(x)
                t = lambda j, k: tables[min(1, max(0, j)), min(1, max(0, k))][v]  # noqa: B023, E731
                up = t(y0, x0) * (1 - (x - x0)) + t(y0, x0 + 1) * (x - x0)
                down = t(y0 + 1, x0) * (1 - (x - x0)) + t(y0 + 1, x0 + 1) * (x - x0)
                want.append(math.floor(up * (1 - (y - y0)) + down * (y - y0) + 0.5))
        assert got[i] == want


def test_frames_take_every_sample(spark):
    rows = [(line, k, k % 5, k % 3, k % 7, k % 256, (k * 7 + line) % 256) for line, n in ((1, 130), (2, 64), (3, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "line long, row_id long, p long, s long, g long, r long, r2 long")
    got = {r.frame_id: (r.a, r.b) for r in images.frames(df.repartition(3)).collect()}
    assert len(got) == 3 + 1 + 1
    line = [r[5] for r in rows if r[0] == 1]
    a = [v for k in range(3) for v in got[1_000_000_000 + k][0]]
    assert a == line + [line[-1]] * (192 - 130)
    assert got[3_000_000_000] == ([0] * 64, [3] * 64)


def test_smoothing_of_long_clips(spark):
    rng = random.Random(1)
    rows = [(c, n, rng.random() if n % 11 else None) for c, size in ((1, 400), (2, 3)) for n in range(size)]
    got = {(r.clip_id, r.n): r.smooth for r in temporal.smoothed(spark.createDataFrame(rows, "clip_id long, n long, v double"), "v", 0.99).collect()}
    for clip in (1, 2):
        m, k = 0.0, 0
        for c, n, v in rows:
            if c != clip:
                continue
            if v is not None:
                m, k = 0.99 * m + 0.01 * v, k + 1
            want = m / (1 - 0.99**k) if k else None
            assert got[c, n] == want or abs(got[c, n] - want) < 1e-9


def test_ranks_values_and_cut_points(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, v long, i long")
    for r in ranking.group_ranks(df, ["g"], [F.col("v").desc(), F.col("i")]).collect():
        assert r["rank"] == sorted((-v, i) for g, v, i in rows if g == r.g).index((-r.v, r.i)) + 1
    values = sorted(v for _, v, _ in rows)
    assert ranking.values_at(df, "v", [0, 17, 250, 499]) == [values[k] for k in (0, 17, 250, 499)]
    fill = tabular.FillMissing(["v"]).fit(df.unionByName(spark.createDataFrame([(0, None, 0)], "g long, v long, i long")))
    assert fill.fills == {"v": (values[249] + values[250]) / 2}
    keys = [r.i for r in df.select("i", dataset.draw(5, "i").alias("d")).orderBy("d", "i").collect()]
    for n in (1, 7, 499, 500):
        assert sorted(r.i for r in df.where(dataset.first_in_order(df, n, 5, "i")).collect()) == sorted(keys[:n])
    assert df.where(dataset.first_in_order(df, 0, 5, "i")).count() == 0


def test_nearest_keys_by_brute_force(spark):
    rng = np.random.default_rng(3)
    keys = np.round(rng.normal(size=(90, 4)), 1)
    q = spark.createDataFrame([(i, keys[i].tolist()) for i in range(0, 90, 20)], "id long, vector array<double>")
    k = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(keys)], "id long, vector array<double>")
    for sizes in ((2, 7), (100, 1000)):
        got = {}
        for r in memory.top_k(q, k, 5, *sizes).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.key_id))
        for i in range(0, 90, 20):
            score = keys @ keys[i]
            assert [x for _, x in sorted(got[i])] == sorted(range(90), key=lambda j: (-score[j], j))[:5]


TEXTS = [None, "", "no no no no no", "a, a, a, a, b", "la la la la la la end", "Été été ÉTÉ naïve aaaa éééé 世世世世 x", "x&amp;lt;y &copy; &#233; &eacute;t&eacute; &notanentity;", "one two  three four four four four"]


def test_repeated_words_and_references(spark):
    rule = re.compile(r"(\b\w+\W+)(\1{3,})")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    for r in df.select("i", text.mark_word_repeats(F.col("t")).alias("w"), text.unescaped(F.col("t")).alias("u")).collect():
        t = TEXTS[r.i]
        assert r.w == (t if t is None else rule.sub(lambda m: f" xxwrep {len(m[2].split()) + 1} {m[1]} ", t))
        assert r.u == (t if t is None else html.unescape(t))


@pytest.mark.parametrize("held", [text.HELD, 2])
def test_ids_and_back(spark, held):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    tokens = text.mark_caps(text.word_tokens(F.col("t")))
    vocab = text.vocabulary(text.token_counts(df, tokens), 50, 2).cache()
    ids = {r.token: r.id for r in vocab.collect()}
    rows = {r.i: r.tokens for r in df.select("i", tokens.alias("tokens")).collect()}
    assert rows[5][:6] == ["xxmaj", "été", "été", "xxup", "été", "naïve"]
    found = text.numericalize(df, "i", tokens, vocab, held)
    assert {r.i: r.ids for r in found.collect()} == {i: t if t is None else [ids.get(x, 0) for x in t] for i, t in rows.items()}
    back = {r.i: r.text for r in text.textify(found.where("size(ids) > 0"), "i", "ids", vocab, held).collect()}
    assert back == {i: " ".join(x if x in ids else "xxunk" for x in t) for i, t in rows.items() if t}


def test_language_model_windows(spark):
    rng = random.Random(7)
    docs = [(i, [rng.randint(0, 99) for _ in range(rng.randint(0, 30))]) for i in range(40)]
    stream = [x for _, ids in docs for x in ids]
    df = spark.createDataFrame(docs, "i long, ids array<long>").repartition(5)
    lanes, width = 3, 7
    lane = len(stream) // lanes
    want = {}
    for k in range(lanes):
        own = stream[k * lane : (k + 1) * lane]
        for w in range(0, lane - 1, width):
            x, y = own[w : min(w + width, lane - 1)], own[w + 1 : w + 1 + width]
            want[k, w // width] = (x, y)
    got = {(r.lane, r.window): (r.x, r.y) for r in text.lm_windows(df, "i", "ids", lanes, width).collect()}
    assert got == want
    assert text.lm_windows(df.limit(0), "i", "ids", lanes, width).count() == 0


def test_canny_by_loops(stack):
    rows, df = stack
    got = {r.frame_id: r.v for r in images.canny(df, 200.0, 500.0).collect()}
    spots = [(r, c) for r in range(SIDE) for c in range(SIDE)]
    for i, a, _ in rows:
        grad = {}
        for r, c in spots:
            gx = sum(w * (at(a, r + d, c + 1) - at(a, r + d, c - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (at(a, r + 1, c + d) - at(a, r - 1, c + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            grad[r, c] = (gx, gy, abs(gx) + abs(gy))
        size = lambda r, c: grad[r, c][2] if (r, c) in grad else 0  # noqa: B023, E731
        thin = {}
        for r, c in spots:
            gx, gy, v = grad[r, c]
            way = int((math.degrees(math.atan2(gy, gx)) % 180 + 22.5) // 45) % 4
            y, x = [(0, 1), (1, 1), (1, 0), (1, -1)][way]
            thin[r, c] = v if v > size(r - y, c - x) and v >= size(r + y, c + x) else 0
        kept = {p for p in spots if thin[p] > 500}
        todo = list(kept)
        while todo:
            r, c = todo.pop()
            for p in [(r + y, c + x) for y in (-1, 0, 1) for x in (-1, 0, 1)]:
                if p in thin and thin[p] > 200 and p not in kept:
                    kept.add(p)
                    todo.append(p)
        assert got[i] == [255 if p in kept else 0 for p in spots]


def test_equalising_by_loops(stack):
    rows, df = stack
    flat = {r.frame_id: r.v for r in images.equalised_frames(df, "flat").collect()}
    wide = {r.frame_id: r.v for r in images.equalised_frames(df, "table").collect()}
    mixed = {r.frame_id: r.v for r in images.equalised_frames(df, "mix", 0.25).collect()}
    tiles = {r.frame_id: r.v for r in images.clahe(df).collect()}
    for i, a, _ in rows:
        if not 0.15 <= sum(a) / 64 / 255 <= 0.70:
            assert flat[i] == wide[i] == mixed[i] == a
            continue
        first = a.count(min(a))
        want = [math.floor((sum(x <= v for x in a) - first) * 255 / (64 - first) + 0.5) for v in a]
        assert flat[i] == want
        low, high = min(a), max(a)
        assert wide[i] == [math.floor((math.floor((v - low) * 255 / (high - low)) / 255) ** (1 / 1.2) * 255) for v in a]
        assert mixed[i] == [math.floor(t * 0.75 + f * 0.25) for t, f in zip(tiles[i], want)]
    with pytest.raises(ValueError):
        images.equalised_frames(df, "other")


def test_late_rows_are_dropped(spark, tmp_path):
    from tidemark.streaming import events

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    day = lambda d, h: f"2020-01-{d:02d} {h:02d}:10:00"
    batches = [[(1, day(1, 0)), (2, day(9, 0))], [(4, day(9, 1))], [(3, day(1, 0))], [(5, day(20, 0))], [(6, day(20, 0))]]
    for k, rows in enumerate(batches):
        full = spark.createDataFrame([(i, ts, 1, "view", 1.0) for i, ts in rows], "event_id long, ts string, user_id long, event_type string, value double")
        full.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    paths = sorted(tmp_path.glob("in/*/*.parquet"))
    for k, p in enumerate(paths):
        import os

        os.utime(p, (1_000_000 + k, 1_000_000 + k))  # the order in which a stream takes them
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    out = events.drained(events.tumbling_counts(stream, late="1 day"))
    assert sorted((str(r.start), r.n) for r in out.collect()) == [("2020-01-01 00:00:00", 1), ("2020-01-09 00:00:00", 1), ("2020-01-09 01:00:00", 1)]
    sliding = events.drained(events.sliding_counts(stream, "2 hours", "1 hour"), "append")
    assert {str(r.start): r.n for r in sliding.collect()}["2020-01-09 00:00:00"] == 2


def test_references_and_folders(spark):
    from tidemark.operators import joins

    df = spark.createDataFrame([(1, n, n < 2) for n in range(5)], "clip_id long, n long, flag boolean")
    with pytest.raises(Exception, match="too few references"):
        temporal.flagged_references(df, F.col("flag")).collect()
    assert temporal.flagged_references(df, F.col("flag"), 2).count() == 2
    found = spark.createDataFrame([(1, "a/ref_000000.png", "x"), (1, "b/ref_000000.png", "y"), (2, "c/ref_000001.png", "z")], "clip_id long, path string, payload string")
    out = joins.replace_payload(df.withColumn("payload", F.lit("old")), found, "payload").orderBy("n").collect()
    assert [r.payload for r in out] == ["x", "old", "old", "old", "old"]
    paths = spark.createDataFrame([("top/train/cat/1.png",), ("top/valid/cat/2.png",), ("other/3.png",), ("4.png",)], "path string")
    assert sorted((r.path[4:9], r.split) for r in dataset.split_by_folder(paths, F.col("path")).collect()) == [("train", "train"), ("valid", "valid")]
    assert [r.x for r in paths.select(dataset.label_from_folder(F.col("path")).alias("x")).collect()] == ["cat", "cat", "other", None]


def test_scene_detection_by_parameters(spark):
    from tidemark.operators import folds
    from tidemark.plans.scenes import scene_detect

    rng = random.Random(5)
    df = spark.createDataFrame([(1, n, round(rng.random(), 3)) for n in range(120)], "clip_id long, n long, luma double")
    changes = lambda out: sorted(r.n for r in out.where("change").collect())
    assert changes(scene_detect(df, 0, 0)) == [] and changes(scene_detect(df, 0, 9)) == list(range(0, 120, 9))
    rows = df.withColumn("diff", temporal.lag_difference("luma"))
    assert changes(scene_detect(df, 0.05)) == changes(folds.detect_scenes(rows, threshold=0.05, min_length=15, black=0.0, white=1.0))
    stateful = scene_detect(df, 0.2, 10, min_length=4)
    assert changes(stateful) == changes(folds.detect_scenes(rows, threshold=0.2, adaptive=1.12, frequency=10, min_length=4, black=0.0, white=1.0))
    filtered = changes(scene_detect(df, 0.2, 10, min_length=4, filtered=True))
    assert 0 < len(filtered) and set(filtered) <= set(changes(stateful))


def test_cleaning_in_order(spark):
    def plain(t):
        for old, new in text.FIXES:
            t = t.replace(old, new)
        t = re.sub(" {2,}", " ", html.unescape(t))
        t = re.sub(r"(\S)(\1{3,})", lambda m: f" xxrep {len(m[2]) + 1} {m[1]} ", t)
        t = re.sub(r"(\b\w+\W+)(\1{3,})", lambda m: f" xxwrep {len(m[2].split()) + 1} {m[1]} ", t)
        return re.sub(" {2,}", " ", re.sub("([/#\n])", r" \1 ", t))

    texts = [t for t in TEXTS if t is not None] + ["a/b #c\n<br />d quot; \\n e", "so so so so so  x", "!!!!! ---- ok ok ok ok ok."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("i", text.clean(F.col("t")).alias("c")).collect():
        assert r.c == plain(texts[r.i])


def test_presets_are_checked_before_anything_runs(spark):
    from tidemark.plans.presets import SPEEDS, Preset, main, stabilised

    for wrong in ({"speed": "warp"}, {"blend": "none"}, {"tune": "x"}, {"saturation": 11}, {"brightness": 300}, {"hue_rule": "370:380|0.5"}):
        with pytest.raises(ValueError):
            Preset(**wrong)
    assert Preset(speed="Placebo").factor == SPEEDS["placebo"]
    df = spark.createDataFrame([(1, n, 200, 100, n * 20, 10, 20, 30) for n in range(6)], "clip_id long, n long, r long, g long, b long, r2 long, g2 long, b2 long")
    fast, slow = (main(Preset(speed=s, tune="balanced"))(df).orderBy("n").collect() for s in ("fast", "placebo"))
    assert [r["or"] for r in fast] == [105] * 6 and all(x.og <= y.og for x, y in zip(slow, fast))
    still = stabilised(dark=None, frames=3, gray=0, near=1.0)(df).orderBy("n").collect()
    assert [r.b for r in still] == [n * 20 for n in range(6)]  # neighbours are too far off
    mean = stabilised(dark=None, frames=3)(df).orderBy("n").collect()
    assert [r.b for r in mean] == [math.floor((33 * max(0, n - 1) * 20 + 34 * n * 20 + 33 * min(5, n + 1) * 20) / 100) for n in range(6)]
