"""Cases that only larger tables bring up, of the operators for training data."""

import random
import re
import tracemalloc

import numpy as np

import corpus_pipeline
from tidemark import session
from tidemark.llm import collocations, quality, simhash


def test_threshold_counts_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    score, good = np.round(rng.normal(0.5, 0.1, 30_000), 3), rng.random(30_000) < 0.9
    score = score + (~good) * 0.2  # more labelled rows than were ever drawn
    best, want = 0.0, np.inf
    for t in np.unique(score):
        lost = (score[good] > t).mean()
        if lost <= quality.SPARE and (gain := (score[~good] > t).mean() - lost) > best:
            best, want = gain, float(t)
    rows = spark.createDataFrame([(float(s), int(g)) for s, g in zip(score, good)], "score double, quality int")
    assert quality.calibrate(rows) == want
    assert quality.calibrate(rows.where("quality = 1")) == np.inf and quality.calibrate(rows.limit(0)) == np.inf


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    seen = []
    real = simhash.links

    def links(fps, *rest):
        seen.append(fps.count())
        return real(fps, *rest)

    monkeypatch.setattr(simhash, "links", links)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words).upper(), " ".join(words[::-1]), " ".join(words[:230])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert seen and seen[0] <= 4  # different fingerprints of all texts went into the grid
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]


def phrase_docs(spark):
    words = [f"w{i}" for i in range(20)]
    rng = random.Random(2)
    return spark.createDataFrame([(k, " ".join(rng.choices(words, k=50)), "en") for k in range(200)], "doc_id long, text string, lang string")


def test_phrases_take_small_batches(spark, monkeypatch):
    key, seen, staged = "spark.sql.execution.arrow.maxBytesPerBatch", {}, collocations.staged
    before = spark.conf.get(key)
    monkeypatch.setattr(collocations, "staged", lambda df, name, *a: seen.setdefault(name, []).append(spark.conf.get(key)) or staged(df, name, *a))
    assert collocations.digest(phrase_docs(spark)).count() > 0
    small = str(session.BATCH_BYTES)
    assert seen == {"position-bitmaps": [small], "phrase-counts": [small] * 2} and spark.conf.get(key) == before


def test_phrases_are_summed_after_the_shuffle(spark, monkeypatch):
    shards = collocations.bitmaps(phrase_docs(spark), 3_000)
    monkeypatch.setattr(session, "PART_ROWS", 20)
    counts = collocations.phrase_counts(shards, 2)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.partition("Exchange")[2]  # what stands below it
    assert int(re.search(r"hashpartitioning\(.*?, (\d+)\)", plan)[1]) == 200 * 50 // collocations.WORDS_A_ROW // 20  # follows the words
    assert counts.where("phrase not like '% %'").selectExpr("sum(f)").first()[0] == 200 * 50


def test_a_shard_is_made_in_little_memory():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(2_000)]
    texts = [" ".join(rng.choices(words, k=1_000)).encode() for _ in range(300)]
    collocations._shard("en", texts[:1])
    tracemalloc.start()
    made = collocations._shard("en", texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.column("n")[0].as_py() == 300_000
    assert peak < 40 * 300_000  # bytes of arrays a word
