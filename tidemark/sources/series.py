"""Ordered series: rows addressed by (clip_id, n), n dense from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import group_ranks
from tidemark.session import dealt, table


def number(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with ``n``, the position in each key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("n", (F.row_number().over(w) - 1).cast("long"))


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, n, luma, flag, kind and value from the event table: a clip for each user."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return number(events, "user_id", "ts", "event_id").select(
        F.col("user_id").alias("clip_id"),
        "n",
        (F.least("value", F.lit(500.0)) / 500).alias("luma"),
        (F.col("event_type") == "signup").alias("flag"),
        F.col("event_type").alias("kind"),
        "value",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 8-bit RGB samples a row (r, g, b and r2, g2, b2), made of the line items' keys."""
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr(
        "l_orderkey AS row_id",
        "l_linenumber AS line",
        "l_partkey AS p",
        "l_suppkey AS s",
        "l_partkey % 256 AS r",
        "l_suppkey % 256 AS g",
        "(l_linenumber * 37 + CAST(l_quantity AS BIGINT)) % 256 AS b",
        "l_orderkey % 256 AS r2",
        "(l_partkey * 7 + l_linenumber) % 256 AS g2",
        "(l_suppkey * 13 + l_partkey) % 256 AS b2",
    )


def sample_count(spark: SparkSession, sf_dir: str) -> int:
    """How many samples ``pixels`` has."""
    return table(spark, sf_dir, "lineitem").count()


def plane_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with their place (plane, x, y) on a plane of 64 x 48 for each supplier, dealt by place: one may have several."""
    placed = pixels(spark, sf_dir).select(
        F.col("s").alias("plane"), (F.col("row_id") % 64).alias("x"), (F.col("p") % 48).alias("y"), "r", "g", "b", "r2", "g2", "b2"
    )
    return dealt(placed, sample_count(spark, sf_dir), "plane", "x", "y")


def plane_cells(spark: SparkSession, sf_dir: str, width: int = 128) -> DataFrame:
    """Cells (plane, x, y, v and w) of planes ``width`` wide: the samples of each line in order, as many whole rows as they fill."""
    cells = group_ranks(pixels(spark, sf_dir).select("line", "row_id", "p", "s", "r", "r2"), ["line"], [F.col(c) for c in ("row_id", "p", "s")])
    whole = cells.groupBy("line").agg(F.expr(f"max(rank) div {width}").alias("rows"))  # one row a plane
    at = F.col("rank") - 1
    placed = cells.join(whole, "line").select(
        F.col("line").cast("long").alias("plane"), (at % width).alias("x"), F.expr(f"(rank - 1) div {width}").alias("y"), F.col("r").alias("v"), F.col("r2").alias("w"), "rows"
    )
    return placed.where("y < rows").drop("rows")
