"""Hand-checked cases of the operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dataset, folds, images, joins, memory, metrics, pixels, tabular, temporal, text
from tidemark.sources import files


def clip(spark, rows, schema):
    return spark.createDataFrame(rows, f"clip_id long, n long, {schema}")


def test_weights():
    assert temporal.even_weights(3) == [33, 34, 33]
    assert temporal.even_weights(5) == [20] * 5
    assert temporal.falling_weights(5) == [6, 13, 62, 13, 6]
    assert all(sum(f(n)) == 100 for n in range(1, 20) for f in (temporal.even_weights, temporal.falling_weights))


def test_distance_counts_from_the_last_kept_flag(spark):
    df = clip(spark, [(1, n, n in (0, 3, 5, 9, 10, 14)) for n in range(15)] + [(2, 0, False), (2, 1, True)], "flag boolean")
    kept = folds.keep_distant(df, "flag", 5).where("kept").select("clip_id", "n").collect()
    assert sorted(map(tuple, kept)) == [(1, 0), (1, 5), (1, 10), (2, 1)]


def test_frozen_difference_inside_the_minimum_length(spark):
    df = clip(spark, [(1, 0, 0.1, 0.5), (1, 1, 0.9, 0.5), (1, 2, 0.2, 0.5), (1, 3, 0.2, 0.5)], "diff double, luma double")
    rows = folds.detect_scenes(df, min_length=2).orderBy("n").collect()
    assert [(r.change, r.ratio) for r in rows] == [(True, 1.0), (False, 0.0), (True, 2.0), (False, 0.0)]


def test_splice_gather_and_names(spark):
    a, b = clip(spark, [(1, 0, "a"), (1, 1, "b")], "v string"), clip(spark, [(1, 5, "c"), (2, 0, "d")], "v string")
    assert sorted((r.clip_id, r.n, r.v) for r in joins.splice(a, b).collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")]
    assert [r.v for r in joins.gather(a, [1, 0, 1]).orderBy("n").collect()] == ["b", "a", "b"]
    with pytest.raises(ValueError):
        joins.gather(a, [])


def test_payload_of_references(spark):
    df = clip(spark, [(1, 0, True, "x"), (1, 1, True, "y"), (1, 2, False, "z")], "flag boolean, payload string")
    found = spark.createDataFrame([("/d/ref_000001.png", "new"), ("/d/ref_000002.png", "no")], "path string, payload string")
    rows = joins.replace_payload(df, found, "payload").orderBy("n").collect()
    assert [(r.payload, r.flag) for r in rows] == [("x", True), ("new", False), ("z", False)]


def test_merge_short_cuts(spark):
    df = spark.createDataFrame([(10, 20, 30, 110, 120, 130)], "r long, g long, b long, r2 long, g2 long, b2 long")
    a, b = pixels.rgb("r", "g", "b"), pixels.rgb("r2", "g2", "b2")
    for method, w, want in ((0, 0.5, (10, 20, 30)), (1, 0.5, (110, 120, 130)), (2, 0, (10, 20, 30)), (2, 1, (110, 120, 130)), (2, 0.5, (60, 70, 80))):
        assert tuple(df.select(*pixels.merge(a, b, method, w)).first()) == want
    assert tuple(df.select(*pixels.merge(None, b, 2)).first()) == (110, 120, 130)
    with pytest.raises(ValueError):
        pixels.merge(a, b, 9)
    for method in (3, 4, 5, 6, 7):
        assert all(0 <= v <= 255 for v in df.select(*pixels.merge(a, b, method)).first())


def test_hue_rules(spark):
    assert pixels.parse_hues("red, 200:260") == [(0.0, 30.0), (200.0, 260.0)]
    with pytest.raises(ValueError):
        pixels.parse_hues("30:10")
    df = spark.createDataFrame([(250, 10, 10), (10, 250, 10)], "r long, g long, b long")
    rows = df.select(pixels.hue(pixels.rgb("r", "g", "b")).alias("h"), *pixels.hue_adjusted(pixels.rgb("r", "g", "b"), "100:140|0.5,1.0")).collect()
    assert [r.h for r in rows] == [0.0, 60.0] and tuple(rows[0])[1:] == (250, 10, 10) and tuple(rows[1])[1:] != (10, 250, 10)


def test_identical_and_disjoint_histograms(spark):
    h = spark.createDataFrame([(1, 3, 4), (1, 9, 6)], "k long, bin long, n long")
    g = spark.createDataFrame([(1, 4, 5)], "k long, bin long, n long")
    assert images.hellinger(h, h, "k").first().similarity == 1.0
    assert images.hellinger(h, g, "k").first().similarity == 0.0


def test_fit_and_apply(spark):
    train = spark.createDataFrame([("b", 1.0, 1.0), ("a", None, 2.0), ("b", 3.0, 3.0)], "c string, x double, y double")
    test = spark.createDataFrame([("a", None, 2.0), ("z", 5.0, 2.0), (None, 1.0, 2.0)], "c string, x double, y double")
    chain = tabular.Chain([tabular.FillMissing(["x", "y"]), tabular.Normalize(["y"]), tabular.Categorify(["c"])]).fit(train)
    rows = {r.c: r for r in chain.apply(test).collect()}
    assert [rows[c].c_code for c in ("a", "z", None)] == [1, 0, 0]
    assert rows["a"].x == 2.0 and rows["a"].x_na and not rows["z"].x_na and abs(rows["a"].y) < 1e-6
    with pytest.raises(Exception, match="nulls"):
        chain.apply(spark.createDataFrame([("a", 1.0, None)], test.schema)).collect()


def test_text_rules(spark):
    df = spark.createDataFrame([("aaaa bbb  THE Cat ha ha ha ha x/y",)], "t string")
    row = df.select(text.mark_repeats(F.col("t")), text.mark_word_repeats(F.col("t")), text.mark_caps(text.split_tokens(F.col("t")))).first()
    assert row[0] == " xxrep 4 a  bbb  THE Cat ha ha ha ha x/y"
    assert row[1] == "aaaa bbb  THE Cat  xxwrep 4 ha  x/y"
    assert row[2][:6] == ["aaaa", "bbb", "xxup", "the", "xxmaj", "cat"]


def test_scores_of_a_small_table(spark):
    cm = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 1, 3), (1, 0, 2), (2, 2, 4)], "target long, pred long, n long")
    s = {r["class"]: r for r in metrics.class_scores(cm).collect()}
    assert abs(s[0].precision - 5 / 7) < 1e-6 and abs(s[0].recall - 5 / 6) < 1e-6 and abs(s[2].fbeta - 1) < 1e-6
    pairs = {(r.target, r.pred): r.n for r in cm.collect()}
    r, c = {0: 6, 1: 5, 2: 4}, {0: 7, 1: 4, 2: 4}
    for kind, w in (("linear", lambda d: abs(d)), ("quadratic", lambda d: d * d)):
        want = 1 - 15 * sum(w(t - p) * n for (t, p), n in pairs.items()) / sum(w(t - p) * r[t] * c[p] for t in r for p in c)
        assert abs(metrics.kappa(cm, kind).first().kappa - want) < 1e-4
    assert abs(metrics.kappa(cm).first().kappa - (0.8 - 78 / 225) / (1 - 78 / 225)) < 1e-4


def test_top_k_with_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    k = spark.createDataFrame([(i, [0.5, float(i)]) for i in range(40)] + [(99, [0.9, 0.0])], "id long, vector array<double>")
    rows = memory.top_k(q, k, 3, query_block=2, key_block=3).orderBy("rank").collect()
    assert [r.key_id for r in rows] == [99, 0, 1]


def test_eviction_drops_ties(spark):
    used = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.2), (4, 0.5)], "key_id long, usage double")
    assert sorted(r.key_id for r in memory.evict(used, 2).collect()) == [4]


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    a, b = (dataset.split_by_rand_pct(df, 0.2, 3, "k") for _ in range(2))
    assert a.where("split = 'valid'").count() == 20
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert dataset.split_by_rand_pct(df, 0.0, 3, "k").where("split = 'valid'").count() == 0


def test_files(spark, tmp_path):
    for name in ("ref_000012.png", "ref_000003.JPG", ".hidden.png", "note.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ref_000099.png").write_text("x")
    assert sorted(r.n for r in files.references(spark, str(tmp_path)).collect()) == [3, 12]
    assert files.listing(spark, str(tmp_path), ("png",)).count() == 2
    assert files.listing(spark, str(tmp_path), include=("sub",)).count() == 1
    df = spark.createDataFrame([(1, 2.5, None)], "a int, b double, c string")
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value == "1,2.500000,#na#"


def test_prefix_sums(spark):
    import random

    from tidemark.operators.ranking import prefix_sums

    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "k long, x long").repartition(9)
    for down in (False, True):
        rows = sorted(prefix_sums(df, "k", ["x"], down).collect(), key=lambda r: r.rank)
        assert [r.k for r in rows] == sorted(values, reverse=down) and [r.rank for r in rows] == list(range(1, 501))
        total = 0
        for r in rows:
            total += r.x
            assert r.run_x == total
    assert prefix_sums(df.limit(0), "k", ["x"]).count() == 0


def test_auc_by_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randint(0, 20), rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score long, target long")
    p, n = [s for s, t in rows if t], [s for s, t in rows if not t]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n)
    assert abs(metrics.auc(df).first().auc - want) < 1e-4


def test_staged_tables_are_released(spark):
    import os

    from tidemark import session

    since = session.staged_so_far()
    a, b = (session.staged(spark.range(n), "some table") for n in (3, 4))
    where = [p.removeprefix("file://") for p in session._TABLES[since:]]
    session.release(spark, since, b)
    assert [os.path.exists(p) for p in where] == [False, True] and b.count() == 4
    session.release(spark, since)
    assert not os.path.exists(where[1]) and session.staged_so_far() == since


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from tidemark import session

    context = Fake(getConf=dict, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError):
        session.shared_dir(Fake(sparkContext=context))


def test_longest_batch_goes_first(spark):
    rows = [(1, "a", 3), (2, "a", 9), (3, "b", 9), (4, "b", None), (5, "c", 1), (6, "d", 2)]
    df = spark.createDataFrame(rows, "id long, batch string, n long")
    found = {r.id: r.turn for r in dataset.batch_turns(df, "n", 5, "id").collect()}
    order = ["a", *sorted("bcd", key=lambda b: hashlib.md5(f"5|{b}".encode()).hexdigest())]
    assert found == {i: order.index(b) for i, b, _ in rows}
    assert dataset.batch_turns(df.limit(0), "n", 5, "id").count() == 0
