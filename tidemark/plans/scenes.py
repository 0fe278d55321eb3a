"""Scene detection by parameters: which detector and which filters run is decided before any row is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import folds, temporal


def scene_detect(
    df: DataFrame, threshold: float = 0.1, frequency: int = 0, min_length: int = 1, offset: int = 1, black: float = 0.0, white: float = 1.0, filtered: bool = False
) -> DataFrame:
    """``df`` (clip_id, n, luma) with ``change``.

    No threshold and no frequency: no row changes. Frequency alone: every k-th row. A plain difference decides where the threshold
    is 0.1 at least, the offset 1 and nothing is filtered; else the detector with state. ``filtered`` then keeps rows that stand
    against the last kept one. Offset and length lie within 1 to 25.
    """
    offset, min_length = max(1, min(25, offset)), max(1, min(25, min_length))
    if not threshold and not frequency:
        return df.withColumn("change", F.lit(False))
    if not threshold:
        return df.withColumn("change", temporal.every_kth(frequency))
    rows = df.withColumn("_diff", temporal.lag_difference("luma", offset))
    lit = temporal.between_lumas("luma", black, white)
    if threshold >= 0.1 and offset == 1 and min_length == 1 and not filtered:
        hit = (F.col("_diff") > threshold) | (temporal.every_kth(frequency) if frequency > 1 else F.lit(False))
        return rows.withColumn("change", (F.col("n") == 0) | (hit & lit)).drop("_diff")
    length = min_length if filtered or min_length > 1 else 15
    found = folds.detect_scenes(rows, "_diff", "luma", threshold, 1.12 if frequency else 1.02, frequency, length, black, white).drop("_diff", "ratio")
    if not filtered:
        return found
    kept = folds.filter_changes(found, "change", "luma")
    return kept.withColumn("change", F.col("reason").isin(1, 2, 3)).drop("reason")
