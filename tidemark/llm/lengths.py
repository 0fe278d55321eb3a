"""Exact histogram of encoded lengths, and what it answers for every context limit.

Each task counts its documents by encoded length, so only (length, count) pairs are shuffled. From the histogram, sums
over longer lengths (suffix sums) give, for a limit of L ids: documents longer than L, ids kept when each document is
truncated to L, and ids lost. One row for every length that occurs answers every limit: between two lengths the number
of longer documents stays, so kept ids grow by it with each id of the limit.

Defined results: a null or empty text has length 0; ties and repeated rows count each; an empty table gives an empty
histogram; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_path, encoder, slices
from tidemark.session import staged


def histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """length and n_docs of every encoded length that occurs."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = encoder(path), {}
        for b in (x for batch in batches for x in slices(batch, "text")):
            for ids in enc.encode_many(b.column("text").to_pylist()):
                n = len(ids) // enc.dtype.itemsize
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n"]
        )

    partial = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "length long, n long")
    return staged(partial.groupBy("length").agg(F.sum("n").alias("n_docs")), "lengths")  # texts are encoded once


def context_report(hist: DataFrame, span: int = 64) -> DataFrame:
    """``hist`` with suffix sums at each length: n_longer, kept_tokens, lost_tokens, total_tokens, quantile.

    Lengths are summed by spans of ``span`` first, so that no task but the one over spans sees the whole range.
    """
    whole = hist.withColumn("_span", F.floor(F.col("length") / span))
    tokens = F.col("length") * F.col("n_docs")
    per = whole.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    after, every = Window.partitionBy(F.lit(0)).orderBy(F.col("_span").desc()), Window.partitionBy(F.lit(0))
    above = after.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "_span",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_da"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_ta"),
        F.sum("_d").over(every).alias("_all_d"),
        F.sum("_t").over(every).alias("_all_t"),
    )
    inside = Window.partitionBy("_span").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("_da") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    beyond = F.col("_ta") + F.coalesce(F.sum(tokens).over(inside), F.lit(0))
    out = whole.join(per, "_span").select(
        "length", "n_docs", longer.alias("n_longer"), beyond.alias("_beyond"), "_all_d", "_all_t"
    )
    lost = F.col("_beyond") - F.col("n_longer") * F.col("length")
    return out.select(
        "length",
        "n_docs",
        "n_longer",
        (F.col("_all_t") - lost).alias("kept_tokens"),
        lost.alias("lost_tokens"),
        F.col("_all_t").alias("total_tokens"),
        ((F.col("_all_d") - F.col("n_longer")) / F.col("_all_d")).alias("quantile"),
    )


def answer(report: DataFrame, limit: int) -> DataFrame:
    """n_docs, n_longer, kept_tokens and lost_tokens at any limit, from the report alone."""
    longer = F.col("length") > limit
    lost = F.sum(F.when(longer, (F.col("length") - limit) * F.col("n_docs")).otherwise(0))
    return report.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs")).otherwise(0)), F.lit(0)).alias("n_longer"),
        F.coalesce(F.max("total_tokens") - lost, F.lit(0)).alias("kept_tokens"),
        F.coalesce(lost, F.lit(0)).alias("lost_tokens"),
    )


def reference_lengths(texts: list[str | None], tokenizer) -> np.ndarray:
    """Lengths by the plain library call, for tests."""
    return np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts])
