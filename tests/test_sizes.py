"""Cases that only tables larger than those of the other tests bring up."""

import datetime

import pyarrow.compute as pc
from pyspark.sql import functions as F
from test_ordered_stream import START, plain

from tidemark.operators import images, memory, metrics, planes, text
from tidemark.plans.pixel_queries import gamma_floor
from tidemark.plans.text_queries import text_fix_html
from tidemark.session import dealt
from tidemark.streaming import events


def test_area_of_many_pairs(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("target"), (F.col("id") % 7).alias("score"))
    assert metrics.auc(df).first().auc == 0.5  # 10^10 pairs, more than 32 bits hold


def test_references_without_semicolon(spark, tmp_path):
    pages = ["<title>a&amp</title>", "b &copy; &middot; &amp;lt;", "&#233;&#xe9; &notit; &copy"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    rows = {r.page_id: r.fixed for r in text_fix_html(spark, f"file://{tmp_path}").collect()}
    assert rows == {0: "<title>a&amp</title>", 1: "b © · &<", 2: "éé &notit; &copy"}
    whole = spark.createDataFrame([("a&amp</title> &notit;",)], "t string").select(text.unescaped(F.col("t"))).first()[0]
    assert whole == "a&</title> ¬it;"


def test_users_share_states(spark, tmp_path):
    rows = [(i, START + datetime.timedelta(minutes=7 * i), i % 90, float(i * 37 % 700)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = events.detect_scenes(events.read(spark, f"file://{tmp_path}/in", 1), buckets=4)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state")
    running = query.trigger(availableNow=True).start()
    running.awaitTermination()
    assert running.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 4  # not one a user
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == plain(rows)


def test_parts_follow_the_input(spark):
    n = lambda rows: dealt(spark.range(10), rows, "id").rdd.getNumPartitions()
    assert n(10) == 4 and n(10_000_000) == 50
    plane = spark.range(12).select(F.floor(F.col("id") / 100).alias("plane"), (F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"), (F.col("id") * F.col("id")).alias("v"))
    found = images.laplacian(plane, ("plane",), 1_000_000)
    assert found.rdd.getNumPartitions() == 25
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, images.laplacian(plane, ("plane",)).collect()))
    assert "Window" not in gamma_floor(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_resampling_shuffles_a_place_once(spark):
    cells = spark.range(300 * 200).select((F.col("id") % 2).alias("plane"), (F.floor(F.col("id") / 2) % 150).alias("x"), F.floor(F.col("id") / 300).alias("y"), (F.col("id") % 251).alias("v"))
    out = planes.resampled(cells, planes.rotation(25.0), side=32)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # was four rows a place
    other = planes.resampled(cells, planes.rotation(25.0), side=500)
    read = lambda df: sorted((r.plane, r.x, r.y, round(r.v, 6)) for r in df.collect())
    assert read(out) == read(other) and out.count() == 60_000


def test_few_rows_at_once_in_python(spark):
    def doubled(items):
        assert len(items) <= 250, "too many rows at once"
        return pc.multiply(items, 2)

    rows = [(i, None if i % 9 == 0 else [i] * (i % 2)) for i in range(900)]
    got = text._mapped(spark.createDataFrame(rows, "i long, v array<long>").coalesce(1), "i", "v", "long", doubled).collect()
    assert sorted(map(tuple, got)) == [(i, None if v is None else [2 * x for x in v]) for i, v in rows]
    keys = spark.range(60).select("id", F.array(F.col("id") % 7).alias("vector"))
    found = memory.top_k(keys.where("id = 20"), keys, 5, step=7).orderBy("rank").collect()
    assert [r.key_id for r in found] == [6, 13, 20, 27, 34]
