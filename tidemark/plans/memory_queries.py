"""Queries over frames, memories with contents, weighted similarity, components and weighted draws, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up
from tidemark.operators import dataset, folds, memory
from tidemark.operators.aggregates import aggregate
from tidemark.operators.ranking import group_ranks
from tidemark.plans.common import PX, r4, registry
from tidemark.session import table
from tidemark.sources.series import number, pixels

QUERIES, ORACLES, query = registry()


def gray_frames(spark, sf_dir, side: int = 16):
    """clip_id, n, luma and frame: each line's samples in order as square gray frames; every four frames show one scene, and samples
    add what differs."""
    size = side * side
    ranked = group_ranks(pixels(spark, sf_dir).select("line", "row_id", "p", "s", "r2"), ["line"], [F.col(c) for c in ("row_id", "p", "s")])
    cells = ranked.select(F.col("line").cast("long").alias("clip_id"), F.expr(f"(rank - 1) div {size}").alias("n"), ((F.col("rank") - 1) % size).alias("k"), "r2")
    scene = F.expr("n div 4")
    cells = cells.withColumn("v", (scene * 53 + F.col("k") * 7 * (scene % 3 + 1) + F.col("r2") % 16) % 256)
    held = cells.groupBy("clip_id", "n").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("c"), F.avg("v").alias("m")).where(F.size("c") == size)
    frame = F.unhex(F.concat_ws("", F.transform("c.v", lambda v: F.lpad(F.hex(v), 2, "0"))))
    return held.select("clip_id", "n", half_up(F.col("m") / 255).alias("luma"), frame.alias("frame"))


@query()
def scene_frame_filter(spark, sf_dir):
    """Even frames that stand against the last kept one by structural similarity and histogram."""
    frames = gray_frames(spark, sf_dir).withColumn("hit", F.col("n") % 2 == 0)
    return folds.filter_scenes(frames, "hit", "luma", "frame", 16, min_length=3).drop("frame", "hit")


@query()
def memory_consolidation(spark, sf_dir):
    """Values read from a working and a long-term memory of each label's vectors."""
    e = number(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    part = lambda a, n: F.slice("embedding", a, n)
    size = F.transform(part(25, 16), lambda x: F.abs(x) + 0.1)
    rows = e.select(F.col("label").cast("long").alias("clip_id"), "n", part(1, 16).alias("key"), part(17, 4).alias("value"), (F.abs(F.col("embedding")[20]) + 1).cast("double").alias("shrink"), size.alias("select"))
    out = folds.remember(rows, "key", "value", "shrink", "select", every=2)
    return out.select("clip_id", "n", "work", "long", *[half_up(F.col("read")[i]).alias(f"v{i}") for i in range(4)])


@query(
    f"""WITH sim AS (SELECT q.vec_id AS query_id, k.vec_id AS key_id,
  -list_sum(list_transform(range(1, 65), lambda i: abs(q.embedding[i]::DOUBLE) * pow(k.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))) * (1 + k.label % 3) / 8 AS s FROM embeddings q JOIN embeddings k ON q.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key_id) AS rank FROM sim QUALIFY rank <= 10)
SELECT query_id, key_id, rank, {r4('s', 3)} AS score FROM top"""
)
def sim_selective_topk(spark, sf_dir):
    """The ten keys nearest to each query by distances that the query weighs and the key shrinks."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    queries = e.where("id % 20 = 0").withColumn("selection", F.transform("vector", lambda x: F.abs(x.cast("double"))))
    found = memory.selective_top_k(queries, e.withColumn("shrinkage", 1 + F.col("label") % 3), 10)
    return found.select("query_id", "key_id", "rank", half_up(F.col("score"), 3).alias("score"))


@query()
def pca_projection(spark, sf_dir):
    """All vectors along their three principal components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    mean, ways, _ = memory.principal_components(e, "embedding", 3)
    out = memory.project(e, "embedding", mean, ways)
    return out.select("vec_id", *[half_up(F.col("projected")[i]).alias(f"p{i}") for i in range(len(ways))])


@query(
    """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT o_orderkey, o_orderstatus, 1000000000 // n AS w FROM orders JOIN c USING (o_orderstatus)),
p AS (SELECT *, CAST(sum(w) OVER (ORDER BY o_orderkey) AS BIGINT) AS hi FROM w), t AS (SELECT max(hi) AS total FROM p), k AS (SELECT max(n) * count(*) AS k FROM c),
d AS (SELECT draw, CAST('0x' || substr(md5('9|' || draw), 1, 15) AS BIGINT) % total AS at FROM (SELECT unnest(range(k)) AS draw FROM k), t)
SELECT o_orderkey, o_orderstatus, draw FROM d ASOF JOIN (SELECT *, hi - w AS lo FROM p) p ON d.at >= p.lo"""
)
def oversample_draws(spark, sf_dir):
    """Orders drawn with replacement so that all states are equally likely."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    counts = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    n = counts.agg(F.max("n") * F.count("*")).first()[0] or 0
    weighted = orders.join(counts, "o_orderstatus").withColumn("weight", F.expr("1000000000 div n"))
    return dataset.weighted_draws(weighted, "weight", n, 9, "o_orderkey").select("o_orderkey", "o_orderstatus", "draw")


_CASE = "l_extendedprice > 30000 AS predicted, l_quantity > 25 AS wanted"


@query(
    f"""WITH c AS (SELECT l_returnflag, l_quantity, l_discount, {_CASE} FROM lineitem)
SELECT l_returnflag, count(*) AS n, {r4("5.0::DOUBLE * count(*) FILTER (predicted AND wanted) / (5 * count(*) FILTER (predicted AND wanted) + 4 * count(*) FILTER (wanted AND NOT predicted) + count(*) FILTER (predicted AND NOT wanted))")} AS f2,
{r4("sum(l_quantity * l_discount) / sum(l_quantity)")} AS mean FROM c GROUP BY l_returnflag"""
)
def user_aggregates(spark, sf_dir):
    """F2 scores and weighted means by an aggregate of a user's own."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "cast(l_quantity as double) AS w", "cast(l_discount as double) AS x", *_CASE.split(", "))

    def update(state, part):
        p, t = part["predicted"].astype(bool), part["wanted"].astype(bool)
        return state + np.array([len(p), (p & t).sum(), (t & ~p).sum(), (p & ~t).sum(), (part["w"] * part["x"]).sum(), part["w"].sum()])

    def finish(s):
        return {"n": int(s[0]), "f2": 5 * s[1] / (5 * s[1] + 4 * s[2] + s[3]), "mean": s[4] / s[5]}

    out = aggregate(rows, ["l_returnflag"], ["predicted", "wanted", "w", "x"], lambda: np.zeros(6), update, np.add, finish, {"n": "long", "f2": "double", "mean": "double"})
    return out.select("l_returnflag", "n", *[half_up(F.col(c)).alias(c) for c in ("f2", "mean")])
