"""Running sums and ranks over a global order, without one task for all rows.

Rows are dealt by range of the order and written with the number of their range. Sums of whole ranges, one row a range, give
offsets; a window inside each range does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged


def prefix_sums(df: DataFrame, order: str, columns: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``df`` with ``rank`` (from 1) and ``run_<c>``, the sum of each column up to and with the row; ``order`` is unique."""
    columns = columns or []
    by = F.col(order).desc() if descending else F.col(order).asc()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_range", F.spark_partition_id())
    rows = staged(dealt, "ranges")
    sums = rows.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in columns])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sums.select("_range", earlier("_n").alias("_o"), *[earlier(f"_s_{c}").alias(f"_o_{c}") for c in columns])
    inside = Window.partitionBy("_range").orderBy(by)
    placed = rows.withColumns(
        {"_r": F.row_number().over(inside)} | {f"_i_{c}": F.sum(c).over(inside) for c in columns}
    ).join(F.broadcast(offsets), "_range")  # one row a range
    return placed.select(
        *df.columns,
        (F.col("_o") + F.col("_r")).cast("long").alias("rank"),
        *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"run_{c}") for c in columns],
    )


def group_ranks(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` (from 1) within each group ``by``; a large group is many ranges. ``by`` and ``order`` are unique together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id())
    rows = staged(dealt, "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range", *by).agg(F.count("*").alias("_n"))  # about a row for each group and each range
    offsets = counts.select("_range", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    placed = rows.withColumn("_r", F.row_number().over(inside)).join(offsets, ["_range", *by])
    return placed.select(*df.columns, (F.col("_o") + F.col("_r")).cast("long").alias("rank"))


def values_at(df: DataFrame, column: str, positions: list[int]) -> list:
    """The values at places (from 0) of a column in ascending order, nulls left out; only these values reach the driver.

    Equal values are counted first, so a value with a third of all rows is one row.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    summed = prefix_sums(values, column, ["n"])
    return list(summed.agg(*[F.min(F.when(F.col("run_n") > p, F.col(column))) for p in positions]).first())
