"""Window operators over ordered series.

All work on rows keyed by (clip_id, n); every window is partitioned by the clip, so clips spread over the cluster and a
clip's rows are sorted once for all windows over the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, half_up
from tidemark.operators.folds import scan


def by_clip() -> WindowSpec:
    """Each clip in order."""
    return Window.partitionBy("clip_id").orderBy("n")


def whole() -> WindowSpec:
    """All rows of a clip, in order."""
    return by_clip().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    """The rows up to each."""
    return by_clip().rowsBetween(Window.unboundedPreceding, 0)


def shifted(x: str, k: int) -> Column:
    """The value k rows later (k > 0) or earlier (k < 0), the clip's first or last one beyond its ends."""
    if k >= 0:
        return F.coalesce(F.lead(x, k).over(by_clip()), F.last(x).over(whole()))
    return F.coalesce(F.lag(x, -k).over(by_clip()), F.first(x).over(whole()))


def lag_difference(x: str, offset: int = 1, least: float = 0.0001, digits: int = 5) -> Column:
    """Absolute difference from ``offset`` rows before, rounded, with a floor."""
    return F.greatest(half_up(F.abs(F.col(x) - shifted(x, -offset)), digits), F.lit(least))


def lead_difference(x: str, offset: int = 1, factor: float = 4.0, digits: int = 5) -> Column:
    """Scaled absolute difference from ``offset`` rows later."""
    return half_up(F.abs(F.col(x) - shifted(x, offset)) * factor, digits)


def every_kth(k: int) -> Column:
    """Row 0 and every k-th row; all rows for k of 1."""
    return F.lit(True) if k == 1 else (F.col("n") == 0) | (F.col("n") % k == 0)


def between_lumas(x: str, black: float, white: float) -> Column:
    """Strictly between two limits."""
    return (F.col(x) > black) & (F.col(x) < white)


def segments(df: DataFrame, flag: Column) -> DataFrame:
    """``df`` with ``segment``: the count of flagged rows up to each row; the first row always starts one."""
    starts = F.when((F.col("n") == 0) | flag, 1).otherwise(0)
    return df.withColumn("segment", F.sum(starts).over(so_far()).cast("long"))


def segment_statistics(df: DataFrame, x: str) -> DataFrame:
    """One row a segment: its first n, rows and mean of ``x``."""
    return df.groupBy("clip_id", "segment").agg(
        F.min("n").alias("start_n"), F.count("*").alias("n_rows"), half_up(F.avg(x)).alias(f"mean_{x}")
    )


def odd_frames(n: int) -> int:
    """A window size in [3, 15], odd."""
    n = max(3, min(15, n))
    return n if n % 2 else n + 1 if n < 15 else n


def even_weights(n: int) -> list[int]:
    """Percent weights that are equal but for the centre, which takes the remainder."""
    n = odd_frames(n)
    each = 100 // n
    return [100 - each * (n - 1) if i == n // 2 else each for i in range(n)]


def falling_weights(n: int) -> list[int]:
    """Percent weights that fall with the distance from the centre, which takes the remainder."""
    n = odd_frames(n)
    half = n // 2
    side = [100 * (i + 1) // (n * (n + 1) // 2) for i in range(half)]
    return [*side, 100 - 2 * sum(side), *reversed(side)]


def weighted_average(x: str, weights: list[int]) -> Column:
    """Centred weighted mean; beyond the ends of a clip its first or last row counts."""
    half = len(weights) // 2
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + shifted(x, i - half) * w if i != half else total + F.col(x) * w
    return total / 100


def limited(x: str, deviation: float) -> Column:
    """``x`` clamped to the row before, give or take a share of it; the first row stays."""
    before = shifted(x, -1)
    d = max(0.01, min(0.5, deviation))
    return clamp(F.col(x), before * (1 - d), before * (1 + d))


def running_median(x: str, radius: int) -> Column:
    """Median over the rows within ``radius``."""
    v = F.array_sort(F.collect_list(x).over(by_clip().rowsBetween(-radius, radius)))
    n = F.size(v)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def pool_average(x: str, size: int) -> Column:
    """Mean of the last ``size`` rows."""
    return F.avg(x).over(by_clip().rowsBetween(-(size - 1), 0))


def smoothed(df: DataFrame, x: str, beta: float) -> DataFrame:
    """``df`` with ``smooth``: bias-corrected exponential smoothing over all rows of a clip so far.

    m(n) = beta * m(n - 1) + (1 - beta) * v(n), divided by 1 - beta^(n + 1); nulls leave the mean as it is.
    """

    def step(state: dict, n: int, v: float | None) -> tuple:
        if v is not None:
            state["m"] = beta * state["m"] + (1 - beta) * v
            state["left"] *= beta
        return (state["m"] / (1 - state["left"]) if state["left"] < 1 else None,)

    return scan(df, [x], lambda: {"m": 0.0, "left": 1.0}, step, {"smooth": "double"})


def elapsed(df: DataFrame, key: str, date: str, flag: Column, *ties: str) -> DataFrame:
    """``df`` with days since the last flagged row (``after``) and until the next (``before``, negative); 0 without one."""
    w = Window.partitionBy(key).orderBy(date, *ties)
    hit = F.when(flag, F.col(date))
    past = F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.first(hit, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    days = lambda since: F.coalesce(F.datediff(F.col(date), since), F.lit(0)).cast("long")
    return df.withColumn("after", days(past)).withColumn("before", days(coming))


def rolling_sums(df: DataFrame, key: str, date: str, x: Column, *ties: str, size: int = 7) -> DataFrame:
    """``df`` with sums of ``x`` over ``size`` rows back (``bw``) and ahead (``fw``), fewer at the ends."""
    w = Window.partitionBy(key).orderBy(date, *ties)
    return df.withColumn("bw", F.sum(x).over(w.rowsBetween(-(size - 1), 0)).cast("long")).withColumn(
        "fw", F.sum(x).over(w.rowsBetween(0, size - 1)).cast("long")
    )


def last_reference(x: str, flag: Column) -> Column:
    """As-of backward: ``x`` of the last flagged row, the clip's first row being one."""
    return F.last(F.when(flag | (F.col("n") == 0), F.col(x)), ignorenulls=True).over(so_far())


def reference_buffer(df: DataFrame, flag: Column, size: int) -> DataFrame:
    """``df`` with ``first_ref`` and ``last_ref``: the ranks of the references in the buffer at each row.

    The buffer holds ``size`` successive references and slides by one when a row passes its middle one,
    so at a row with k references at or before it, the first is k - 1 - half, kept within the references there are.
    """
    half = int(size * 0.5 + 0.5) - 1
    seen = F.sum(F.when(flag, 1).otherwise(0)).over(so_far())
    total = F.sum(F.when(flag, 1).otherwise(0)).over(whole())
    first = F.greatest(F.lit(0), F.least(seen - 1 - half, total - size)).cast("long")
    return df.withColumn("first_ref", first).withColumn("last_ref", F.least(first + size, total).cast("long") - 1)


def repaired_average(x: str, weights: list[int], gray: Column, near: float) -> Column:
    """Centred weighted mean in which a neighbour counts as the row itself where the neighbour is gray or too far off.

    ``gray`` is a condition on a row; ``near`` the largest difference that still counts.
    """
    half = len(weights) // 2
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        k = i - half
        if not k:
            total = total + F.col(x) * w
            continue
        v = shifted(x, k)
        pale = F.coalesce(F.lead(gray, k).over(by_clip()) if k > 0 else F.lag(gray, -k).over(by_clip()), F.lit(False))
        total = total + F.when(pale | (F.abs(v - F.col(x)) > near), F.col(x)).otherwise(v) * w
    return total / 100


def flagged_references(df: DataFrame, flag: Column, least: int = 4) -> DataFrame:
    """The flagged rows of each clip; fewer than ``least`` in a clip are an error when the rows are read."""
    found = df.where(flag).withColumn("_k", F.count("*").over(whole()))
    ok = F.assert_true(F.col("_k") >= least, F.concat(F.lit("too few references in clip "), F.col("clip_id").cast("string")))
    return found.withColumn("n", F.when(ok.isNull(), F.col("n"))).drop("_k")


def clip_constants(df: DataFrame, names: list[str]) -> DataFrame:
    """clip_id and the named properties of each clip's first row; 0 where it has none."""
    first = F.max(F.when(F.col("n") == 0, F.struct(*names))).alias("_p")
    return df.groupBy("clip_id").agg(first).select("clip_id", *[F.coalesce(F.col("_p")[c], F.lit(0)).alias(c) for c in names])


def gated(changed: Column, own: Column, flag: Column) -> Column:
    """``changed`` at a clip's first row and at flagged rows, ``own`` at all others."""
    return F.when((F.col("n") == 0) | flag, changed).otherwise(own)


def reference_merged(pred: Column, ref: Column, flag: Column, w: float) -> Column:
    """Predictions blended into a reference by ``w``; reference rows keep theirs."""
    return F.when(flag, pred).otherwise(pred * (1 - w) + ref * w)
