"""Registered queries over streams, each drained for the input there is, and over files that they write themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.common import registry
from tidemark.session import shared_dir, table
from tidemark.sources import files
from tidemark.streaming import events as e

QUERIES, ORACLES, query = registry()


def _buckets(events: int) -> int:
    """Groups of users that share a state: about 20,000 events each."""
    return max(e.BUCKETS, events // 20_000)


@query(
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL"
)
def stream_tumbling_counts(spark, sf_dir):
    """Events of each type an hour."""
    return e.drained(e.tumbling_counts(e.read(spark, f"{sf_dir}/events.parquet")), "complete")


@query(
    """SELECT s AS start, event_type, count(*) AS n FROM events, range(0, 4) k(i), LATERAL (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i AS s) GROUP BY ALL"""
)
def stream_sliding_counts(spark, sf_dir):
    """Events of each type in hours that start every quarter."""
    return e.drained(e.sliding_counts(e.read(spark, f"{sf_dir}/events.parquet")), "complete")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session_counts(spark, sf_dir):
    """Sessions of each user."""
    return e.drained(e.session_counts(e.read(spark, f"{sf_dir}/events.parquet")), "complete")


@query(
    """WITH RECURSIVE seq AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, least(value, 500) / 500 AS y FROM events),
f AS (SELECT user_id, event_id, n, true AS change, n AS last_n, y FROM seq WHERE n = 0
  UNION ALL SELECT s.user_id, s.event_id, s.n, s.n - f.last_n >= 5 AND abs(s.y - f.y) > 0.1, CASE WHEN s.n - f.last_n >= 5 AND abs(s.y - f.y) > 0.1 THEN s.n ELSE f.last_n END, s.y
  FROM f JOIN seq s ON s.user_id = f.user_id AND s.n = f.n + 1) SELECT user_id, event_id, n, change FROM f"""
)
def stream_scene_detect(spark, sf_dir):
    """Scene changes as events come, with state a user."""
    buckets = _buckets(table(spark, sf_dir, "events").count())
    return e.drained(e.detect_scenes(e.read(spark, f"{sf_dir}/events.parquet"), buckets=buckets))


@query(
    """WITH RECURSIVE seq AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, least(value, 500) / 500 AS y FROM events),
f AS (SELECT user_id, event_id, n, true AS change, n AS last_n, y FROM seq WHERE n = 0
  UNION ALL SELECT s.user_id, s.event_id, s.n, s.n - f.last_n >= 5 AND abs(s.y - f.y) > 0.1, CASE WHEN s.n - f.last_n >= 5 AND abs(s.y - f.y) > 0.1 THEN s.n ELSE f.last_n END, s.y
  FROM f JOIN seq s ON s.user_id = f.user_id AND s.n = f.n + 1) SELECT user_id, event_id, n, change FROM f"""
)
def stream_scenes_in_order(spark, sf_dir):
    """Scene changes of events that batches bring out of order: every fifth comes an eighth of the time late."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    first, last, n = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.count("*")).first()
    span = (last or 0) - (first or 0) + 1
    eighth = F.expr(f"(unix_seconds(ts) - {first or 0}) * 8 div {span}") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    where = f"{shared_dir(spark).rstrip('/')}/unordered-{uuid.uuid4().hex}"
    files = n // 9 // 250_000 + 1  # of a batch
    for k in range(9):
        events.where(eighth == k).repartition(files).write.mode("append").parquet(where)
    end = F.timestamp_seconds(F.lit(float((last or 0) + 3 * span)))  # moves the watermark past all events; its user is none of theirs
    stop = spark.range(1).select((-F.col("id") - 1).alias("event_id"), end.alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value"))
    stop.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.mode("append").parquet(where)
    found, _ = e.drained_counted(e.detect_scenes_in_order(e.read(spark, where, files), late=f"{span // 3} seconds", buckets=_buckets(n)))
    return found.where("user_id >= 0")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read again, nulls refused."""
    where = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    customers.write.csv(where, header=True)
    out = files.read_csv(spark, where, ("c_custkey", "c_mktsegment"))
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment")


@query(
    """SELECT 'p/img' || o_custkey || '.png' AS file_name, list([2.0::DOUBLE, 1.0, o_orderkey % 50 + 2, o_orderkey % 40 + 1] ORDER BY o_orderkey) AS boxes, list(o_orderstatus ORDER BY o_orderkey) AS classes
FROM orders GROUP BY o_custkey"""
)
def coco_annotations(spark, sf_dir):
    """Boxes and classes of images from annotation documents of about fifty images, made of all orders."""
    where = f"{shared_dir(spark).rstrip('/')}/coco-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    mark = F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("image_id"), F.ascii("o_orderstatus").cast("long").alias("category_id"),
        F.array(F.lit(1.0), F.lit(2.0), (F.col("o_orderkey") % 40).cast("double"), (F.col("o_orderkey") % 50).cast("double")).alias("bbox"),
    )
    image = F.struct(F.col("o_custkey").alias("id"), F.concat(F.lit("img"), "o_custkey", F.lit(".png")).alias("file_name"))
    kind = F.struct(F.ascii("o_orderstatus").cast("long").alias("id"), F.col("o_orderstatus").alias("name"))
    documents = orders.groupBy((F.col("o_custkey") / 50).cast("long").alias("document")).agg(
        F.collect_set(image).alias("images"), F.array_sort(F.collect_list(mark)).alias("annotations"), F.collect_set(kind).alias("categories")
    )
    documents.drop("document").write.json(where)
    return files.annotations(spark, where, "p/", lines=True)
