"""Registered queries over ordered sequences: differences, flags, segments, smoothing, references and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up
from tidemark.operators import folds, joins, temporal as t
from tidemark.plans.common import SEQ, r4, registry
from tidemark.sources.series import events_series as series

QUERIES, ORACLES, query = registry()
_W = "PARTITION BY clip_id ORDER BY n"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_DIFF = f"greatest({r4(f'abs(luma - coalesce(lag(luma) OVER ({_W}), luma))', 5)}, 0.0001)"


def _at(x: str, k: int) -> str:
    f, end = (f"lead({x}, {k})", f"last_value({x})") if k >= 0 else (f"lag({x}, {-k})", f"first_value({x})")
    return f"coalesce({f} OVER ({_W}), {end} OVER ({_W} {_ALL}))"


@query(
    f"""WITH {SEQ}, d AS (SELECT *, {_DIFF} AS diff FROM seq),
g AS (SELECT *, sum(CASE WHEN n = 0 OR (diff > 0.3 AND luma > 0.05 AND luma < 0.9) THEN 1 ELSE 0 END)
  OVER ({_W}) AS segment FROM d)
SELECT clip_id, CAST(segment AS BIGINT) AS segment, min(n) AS start_n, count(*) AS n_rows,
  {r4("avg(luma)")} AS mean_luma FROM g GROUP BY clip_id, segment"""
)
def seq_scene_pipeline(spark, sf_dir):
    """Segments of each clip by jumps of luma inside a luma gate, with their statistics."""
    rows = series(spark, sf_dir).select("clip_id", "n", "luma").withColumn("diff", t.lag_difference("luma"))
    cut = (F.col("diff") > 0.3) & t.between_lumas("luma", 0.05, 0.9)
    return t.segment_statistics(t.segments(rows, cut), "luma")


@query(f"WITH {SEQ} SELECT clip_id, n, n = 0 OR n % 12 = 0 AS flag FROM seq")
def scene_freq_flags(spark, sf_dir):
    """Every twelfth row."""
    return series(spark, sf_dir).select("clip_id", "n", t.every_kth(12).alias("flag"))


@query(f"WITH {SEQ} SELECT clip_id, n, {_DIFF} AS diff FROM seq")
def scene_lag_diff(spark, sf_dir):
    """Difference from the row before."""
    return series(spark, sf_dir).select("clip_id", "n", t.lag_difference("luma").alias("diff"))


@query(f"WITH {SEQ} SELECT clip_id, n, {r4(f'abs(luma - {_at("luma", 2)}) * 4', 5)} AS diff FROM seq")
def scene_lead_diff(spark, sf_dir):
    """Difference from two rows later, four times."""
    return series(spark, sf_dir).select("clip_id", "n", t.lead_difference("luma", 2).alias("diff"))


@query(
    f"""WITH {SEQ}, d AS (SELECT *, {_DIFF} AS diff FROM seq)
SELECT clip_id, n, {r4(f"diff / coalesce(lag(diff) OVER ({_W}), diff)")} AS ratio FROM d"""
)
def scene_ratio_stateless(spark, sf_dir):
    """Difference against the one before."""
    rows = series(spark, sf_dir).withColumn("diff", t.lag_difference("luma"))
    return rows.select("clip_id", "n", half_up(F.col("diff") / t.shifted("diff", -1)).alias("ratio"))


@query(
    f"WITH {SEQ} SELECT clip_id, n, n = 0 OR ((flag OR n % 10 = 0) AND luma > 0.1 AND luma < 0.7) AS change FROM seq"
)
def scene_luma_gate(spark, sf_dir):
    """Flags inside a luma gate, the first row always."""
    keep = (F.col("n") == 0) | ((F.col("flag") | (F.col("n") % 10 == 0)) & t.between_lumas("luma", 0.1, 0.7))
    return series(spark, sf_dir).select("clip_id", "n", keep.alias("change"))


@query(
    f"""WITH RECURSIVE {SEQ}, d AS (SELECT clip_id, n, luma, {_DIFF} AS diff FROM seq),
f AS (SELECT clip_id, n, luma, diff, true AS change, CAST(1.0 AS DOUBLE) AS ratio, n AS last_ref, diff AS prev, luma AS ref_luma
      FROM d WHERE n = 0
  UNION ALL
  SELECT clip_id, n, luma, diff, c, CASE WHEN open THEN q ELSE 0.0 END, CASE WHEN c THEN n ELSE last_ref END,
    CASE WHEN open THEN diff ELSE prev END, CASE WHEN c THEN luma ELSE ref_luma END
  FROM (SELECT *, open AND ((q > 1.02 AND diff > 0.1) OR n % 30 = 0 OR (q > 2 AND luma BETWEEN 0.19 AND 0.70) OR q > 15
      OR (ref_luma < 0.19 AND luma BETWEEN 0.19 AND 0.70)) AND luma > 0.1 AND luma < 0.7 AS c
    FROM (SELECT d.clip_id, d.n, d.luma, d.diff, f.last_ref, f.prev, f.ref_luma, d.n - f.last_ref >= 5 AS open,
        {r4("d.diff / f.prev")} AS q FROM f JOIN d ON d.clip_id = f.clip_id AND d.n = f.n + 1)))
SELECT clip_id, n, change, ratio FROM f"""
)
def scene_detect_stateful(spark, sf_dir):
    """Segments by an adaptive ratio that only judged rows advance."""
    rows = series(spark, sf_dir).select("clip_id", "n", "luma", t.lag_difference("luma").alias("diff"))
    found = folds.detect_scenes(rows, frequency=30, min_length=5)
    return found.select("clip_id", "n", "change", "ratio")


@query(
    f"""WITH RECURSIVE {SEQ}, d AS (SELECT clip_id, n, flag, luma, {r4(f'abs(luma - {_at("luma", 1)}) * 0.4', 5)} AS edge,
  {r4(f'abs(luma - {_at("luma", -1)})', 5)} AS plain FROM seq),
f AS (SELECT clip_id, n, CAST(4 AS BIGINT) AS reason, n AS last_n, CAST(4 AS BIGINT) AS last_reason FROM d WHERE n = 0
  UNION ALL
  SELECT clip_id, n, k, CASE WHEN k > 0 THEN n ELSE last_n END, CASE WHEN k > 0 THEN k ELSE last_reason END
  FROM (SELECT *, CAST(CASE WHEN k0 > 0 AND (luma < 0.1 OR luma > 0.7 OR (k0 = last_reason AND n - last_n < 3)) THEN 0 ELSE k0 END AS BIGINT) AS k
    FROM (SELECT d.clip_id, d.n, d.luma, f.last_n, f.last_reason, CASE WHEN flag THEN CASE WHEN edge >= 0.2 THEN 4 ELSE 3 END
        WHEN edge > 0.2 THEN 2 WHEN edge > 0.1 AND plain > 0.175 AND d.n - f.last_n >= 3 THEN 1 ELSE 0 END AS k0
      FROM f JOIN d ON d.clip_id = f.clip_id AND d.n = f.n + 1)))
SELECT clip_id, n, reason FROM f"""
)
def edge_detect_stateful(spark, sf_dir):
    """Segments by flags, edges and plain differences, with the rule that fired."""
    edge = t.lead_difference("luma", 1, 0.4).alias("edge")
    plain = half_up(F.abs(F.col("luma") - t.shifted("luma", -1)), 5).alias("plain")
    rows = series(spark, sf_dir).select("clip_id", "n", "flag", "luma", edge, plain)
    return folds.detect_edges(rows).select("clip_id", "n", "reason")


@query(
    f"""WITH RECURSIVE {SEQ}, f AS (SELECT clip_id, n, kind = 'click' AS kept, CASE WHEN kind = 'click' THEN 0 ELSE -1000000000 END AS last_n
      FROM seq WHERE n = 0
  UNION ALL SELECT s.clip_id, s.n, s.kind = 'click' AND s.n - f.last_n >= 7, CASE WHEN s.kind = 'click' AND s.n - f.last_n >= 7 THEN s.n ELSE f.last_n END
  FROM f JOIN seq s ON s.clip_id = f.clip_id AND s.n = f.n + 1)
SELECT clip_id, n FROM f WHERE kept"""
)
def min_distance_keep(spark, sf_dir):
    """Clicks at least seven rows after the last kept one."""
    rows = series(spark, sf_dir).select("clip_id", "n", (F.col("kind") == "click").alias("hit"))
    return folds.keep_distant(rows, "hit", 7).where("kept").select("clip_id", "n")


@query(
    f"""WITH RECURSIVE {SEQ}, v AS (SELECT clip_id, n, value AS x FROM seq),
f AS (SELECT clip_id, n, x AS best, CAST(0 AS BIGINT) AS wait FROM v WHERE n = 0
  UNION ALL SELECT v.clip_id, v.n, CASE WHEN v.x < f.best - 1 THEN v.x ELSE f.best END,
    CASE WHEN v.x < f.best - 1 THEN 0 ELSE f.wait + 1 END FROM f JOIN v ON v.clip_id = f.clip_id AND v.n = f.n + 1)
SELECT clip_id, n, best, wait, wait > 5 AS stop FROM f"""
)
def early_stopping(spark, sf_dir):
    """Smallest value so far, rows without improvement, and where patience ends."""
    rows = series(spark, sf_dir).select("clip_id", "n", "value")
    return folds.stop_early(rows, "value", 5, 1.0).select("clip_id", "n", "best", "wait", "stop")


@query(
    f"""WITH {SEQ} SELECT clip_id, n, last_value(CASE WHEN flag OR n = 0 THEN n END IGNORE NULLS) OVER ({_W}
  ROWS UNBOUNDED PRECEDING) AS ref_n, last_value(CASE WHEN flag OR n = 0 THEN luma END IGNORE NULLS) OVER ({_W}
  ROWS UNBOUNDED PRECEDING) AS ref_luma FROM seq"""
)
def ref_asof_backward(spark, sf_dir):
    """The last reference at each row."""
    flag = F.col("flag")
    return series(spark, sf_dir).select(
        "clip_id", "n", t.last_reference("n", flag).alias("ref_n"), t.last_reference("luma", flag).alias("ref_luma")
    )


@query(
    f"""WITH {SEQ}, k AS (SELECT clip_id, n, sum(CAST(flag AS INT)) OVER ({_W}) AS seen,
  sum(CAST(flag AS INT)) OVER ({_W} {_ALL}) AS total FROM seq)
SELECT clip_id, n, CAST(greatest(0, least(seen - 1 - 2, total - 5)) AS BIGINT) AS first_ref,
  CAST(least(greatest(0, least(seen - 1 - 2, total - 5)) + 5, total) - 1 AS BIGINT) AS last_ref FROM k"""
)
def ref_buffer_window(spark, sf_dir):
    """The references in a buffer of five at each row."""
    rows = series(spark, sf_dir).select("clip_id", "n", "flag")
    return t.reference_buffer(rows, F.col("flag"), 5).select("clip_id", "n", "first_ref", "last_ref")


@query(
    f"""WITH RECURSIVE {SEQ}, k AS (SELECT clip_id, n, CAST(sum(CAST(flag AS INT)) OVER ({_W} {_ALL}) AS BIGINT) AS total,
  CAST(coalesce(sum(CAST(flag AS INT)) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS ahead FROM seq),
f AS (SELECT clip_id, n, CASE WHEN total > 0 THEN CAST(0 AS BIGINT) END AS next_ref, CAST(CASE WHEN total > 0 THEN 1 ELSE 0 END AS BIGINT) AS rd
      FROM k WHERE n = 0
  UNION ALL SELECT clip_id, n, CASE WHEN go THEN rd END, CASE WHEN go THEN rd + 1 ELSE rd END
  FROM (SELECT k.clip_id, k.n, f.rd, NOT (f.rd >= total OR (f.rd > total // 2 AND ahead >= 4)) AS go
    FROM f JOIN k ON k.clip_id = f.clip_id AND k.n = f.n + 1))
SELECT clip_id, n, next_ref FROM f"""
)
def ref_lookahead(spark, sf_dir):
    """References handed out one a row, held back while enough lie ahead."""
    hit = F.col("flag").cast("long")
    after = t.by_clip().rowsBetween(1, 2**31 - 1)
    rows = series(spark, sf_dir).select(
        "clip_id", "n", "flag", F.sum(hit).over(t.whole()).alias("total"),
        F.coalesce(F.sum(hit).over(after), F.lit(0)).alias("ahead"),
    )
    return folds.look_ahead(rows, "flag", 4).select("clip_id", "n", "next_ref")


@query(
    f"""WITH {SEQ}, other AS (SELECT clip_id, n, value % 7 AS a, kind AS b FROM seq WHERE n % 3 <> 1)
SELECT s.clip_id, s.n, s.luma, coalesce(o.a, s.value) AS value, coalesce(o.b, s.kind) AS kind
FROM seq s LEFT JOIN other o ON s.clip_id = o.clip_id AND s.n = o.n"""
)
def copy_props_join(spark, sf_dir):
    """Named properties taken over from another series where it has the row."""
    s = series(spark, sf_dir)
    other = s.where("n % 3 <> 1").select("clip_id", "n", (F.col("value") % 7).alias("value"), "kind")
    return joins.copy_properties(s, other, ["value", "kind"]).select("clip_id", "n", "luma", "value", "kind")


@query(
    f"""WITH {SEQ}, refs AS (SELECT clip_id, n FROM seq WHERE kind = 'purchase' AND n % 2 = 0)
SELECT s.clip_id, s.n, CAST(CASE WHEN r.n IS NOT NULL THEN 1 WHEN s.flag THEN 1 ELSE 0 END AS BIGINT) AS prev_change,
  CAST(CASE WHEN r.n IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS next_change
FROM seq s LEFT JOIN refs r ON s.clip_id = r.clip_id AND s.n = r.n"""
)
def ref_semi_flag(spark, sf_dir):
    """Rows named by a reference table flagged, the others keep their flag."""
    s = series(spark, sf_dir)
    refs = s.where("kind = 'purchase' and n % 2 = 0").select("clip_id", "n")
    return joins.flag_references(s, refs, merge=True, external=True).select("clip_id", "n", "prev_change", "next_change")


@query(
    f"""WITH {SEQ}, b AS (SELECT clip_id, n, {_at("luma", -1)} AS luma FROM seq)
SELECT a.clip_id, a.n, {r4("a.luma * 0.6 + b.luma * 0.4")} AS luma, a.kind FROM seq a JOIN b ON a.clip_id = b.clip_id AND a.n = b.n"""
)
def frame_zip_merge(spark, sf_dir):
    """Two series row by row, blended; the first one's properties stay."""
    a = series(spark, sf_dir)
    b = a.select("clip_id", "n", t.shifted("luma", -1).alias("other"))
    blended = half_up(F.col("luma") * 0.6 + F.col("other") * 0.4).alias("luma")
    return joins.zip_rows(a, b).select("clip_id", "n", blended, "kind")


def _average(weights: list[int]) -> str:
    half = len(weights) // 2
    return " + ".join(f"{_at('luma', i - half) if i != half else 'luma'} * {w}" for i, w in enumerate(weights))


@query(f"WITH {SEQ} SELECT clip_id, n, {r4(f'({_average([20] * 5)}) / 100')} AS smooth FROM seq")
def temporal_avg_arith(spark, sf_dir):
    """Centred mean of five rows."""
    smooth = half_up(t.weighted_average("luma", t.even_weights(5))).alias("smooth")
    return series(spark, sf_dir).select("clip_id", "n", smooth)


@query(f"WITH {SEQ} SELECT clip_id, n, {r4(f'({_average([6, 13, 62, 13, 6])}) / 100')} AS smooth FROM seq")
def temporal_avg_weighted(spark, sf_dir):
    """Centred mean of five rows, weights falling with the distance."""
    smooth = half_up(t.weighted_average("luma", t.falling_weights(5))).alias("smooth")
    return series(spark, sf_dir).select("clip_id", "n", smooth)


@query(f"WITH {SEQ} SELECT clip_id, n, {r4(f'least(greatest(luma, {_at("luma", -1)} * 0.8), {_at("luma", -1)} * 1.2)')} AS kept FROM seq")
def chroma_limiter(spark, sf_dir):
    """Values clamped to a fifth around the row before."""
    return series(spark, sf_dir).select("clip_id", "n", half_up(t.limited("luma", 0.2)).alias("kept"))


@query(f"WITH {SEQ} SELECT clip_id, n, {r4(f'median(luma) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS mid FROM seq")
def temporal_median(spark, sf_dir):
    """Median of five rows."""
    return series(spark, sf_dir).select("clip_id", "n", half_up(t.running_median("luma", 2)).alias("mid"))


@query(f"WITH {SEQ} SELECT clip_id, n, {_at('luma', -3)} AS past, {_at('luma', 4)} AS coming FROM seq")
def shift_k(spark, sf_dir):
    """Three rows back and four ahead."""
    past, coming = t.shifted("luma", -3).alias("past"), t.shifted("luma", 4).alias("coming")
    return series(spark, sf_dir).select("clip_id", "n", past, coming)


@query(f"WITH {SEQ} SELECT clip_id, n, {r4(f'avg(value) OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS pool FROM seq")
def moving_avg_pool(spark, sf_dir):
    """Mean of the last ten rows."""
    return series(spark, sf_dir).select("clip_id", "n", half_up(t.pool_average("value", 10)).alias("pool"))


@query(
    f"""WITH {SEQ} SELECT a.clip_id, a.n, {r4("sum(b.value * 0.1 * pow(0.9, a.n - b.n)) / (1 - pow(0.9, a.n + 1))")} AS smooth
FROM seq a JOIN seq b ON a.clip_id = b.clip_id AND b.n <= a.n GROUP BY a.clip_id, a.n"""
)
def ema_smooth(spark, sf_dir):
    """Bias-corrected exponential smoothing."""
    rows = t.smoothed(series(spark, sf_dir).select("clip_id", "n", "value"), "value", 0.9)
    return rows.select("clip_id", "n", half_up(F.col("smooth")).alias("smooth"))


@query(f"WITH {SEQ} SELECT clip_id, n - 10 AS n, luma FROM seq WHERE n >= 10 AND n < 40")
def slice_reindex(spark, sf_dir):
    """Rows 10 to 39, numbered anew."""
    return joins.trim(series(spark, sf_dir), 10, 40).select("clip_id", "n", "luma")


@query(
    f"""WITH {SEQ}, a AS (SELECT * FROM seq WHERE n < 10), b AS (SELECT * FROM seq WHERE kind = 'view'),
b2 AS (SELECT *, row_number() OVER ({_W}) - 1 AS m FROM b), k AS (SELECT clip_id, count(*) AS c FROM a GROUP BY clip_id)
SELECT clip_id, n, luma FROM a UNION ALL SELECT b2.clip_id, m + coalesce(c, 0) AS n, luma FROM b2 LEFT JOIN k USING (clip_id)"""
)
def splice_reindex(spark, sf_dir):
    """One series after another, numbered through."""
    s = series(spark, sf_dir).select("clip_id", "n", "luma", "kind")
    return joins.splice(s.where("n < 10"), s.where("kind = 'view'")).select("clip_id", "n", "luma")


@query(
    f"""WITH {SEQ}, list(pos, src) AS (VALUES (0, 5), (1, 3), (2, 3), (3, 20), (4, 0))
SELECT clip_id, CAST(pos AS BIGINT) AS n, luma, n AS from_n FROM seq JOIN list ON n = src"""
)
def gather_by_list(spark, sf_dir):
    """Rows in the order of a list."""
    return joins.gather(series(spark, sf_dir), [5, 3, 3, 20, 0]).select("clip_id", "n", "luma", F.col("at").alias("from_n"))


@query(f"WITH {SEQ} SELECT clip_id, n, printf('ref_%06d.png', n + 100) AS name FROM seq WHERE n % 9 = 0")
def export_every_k(spark, sf_dir):
    """Every ninth row under its exported name."""
    return joins.exported(series(spark, sf_dir), [9], offset=100).select("clip_id", "n", "name")


@query(
    f"""WITH {SEQ} SELECT clip_id, n, printf('ref_%06d.png', row_number() OVER ({_W}) - 1) AS name FROM seq WHERE n = 0 OR flag"""
)
def export_sequence(spark, sf_dir):
    """Flagged rows under running numbers."""
    rows = series(spark, sf_dir).where("n = 0 or flag")
    return joins.numbered(rows).select("clip_id", "n", "name")


@query(
    f"""WITH {SEQ}, c AS (SELECT clip_id, n, n % 8 = 7 OR (flag AND n - coalesce(max(CASE WHEN flag THEN n END)
  OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) >= 1) AS reset FROM seq)
SELECT clip_id, n, CAST(sum(CAST(reset AS INT)) OVER ({_W}) AS BIGINT) AS run, n % 5 = 0 AS is_memory FROM c"""
)
def memory_reset_runs(spark, sf_dir):
    """Runs between resets of a memory, and the rows it takes in."""
    past = F.max(F.when(F.col("flag"), F.col("n"))).over(t.by_clip().rowsBetween(-(2**31), -1))
    reset = (F.col("n") % 8 == 7) | (F.col("flag") & (F.col("n") - F.coalesce(past, F.lit(-1)) >= 1))
    rows = series(spark, sf_dir).withColumn("reset", reset)
    run = F.sum(F.col("reset").cast("long")).over(t.so_far()).alias("run")
    return rows.select("clip_id", "n", run, (F.col("n") % 5 == 0).alias("is_memory"))


@query(
    f"""WITH RECURSIVE {SEQ}, f AS (SELECT clip_id, n, CAST(1 AS BIGINT) AS reason, n AS last_n, luma AS y0 FROM seq WHERE n = 0
  UNION ALL SELECT clip_id, n, CASE WHEN k > 0 AND n - last_n < 3 THEN k + 4 ELSE k END, CASE WHEN k > 0 AND n - last_n >= 3 THEN n ELSE last_n END,
    CASE WHEN k > 0 AND n - last_n >= 3 THEN y ELSE y0 END
  FROM (SELECT *, CAST(CASE WHEN NOT hit THEN 0 WHEN a < 0.9 AND b < 0.95 THEN 1 WHEN y0 < 0.19 AND y >= 0.19 THEN 2 WHEN a >= 0.69 AND b < 0.70 THEN 3 ELSE 0 END AS BIGINT) AS k
    FROM (SELECT s.clip_id, s.n, s.luma AS y, f.y0, f.last_n, s.kind <> 'view' AS hit, {r4("1 - abs(s.luma - f.y0)")} AS a, {r4("1 - abs(s.luma * s.luma - f.y0 * f.y0)")} AS b
      FROM f JOIN seq s ON s.clip_id = f.clip_id AND s.n = f.n + 1)))
SELECT clip_id, n, reason FROM f"""
)
def change_filter_stateful(spark, sf_dir):
    """Flagged rows that stand against the last kept one, with the rule."""
    rows = series(spark, sf_dir).select("clip_id", "n", "luma", (F.col("kind") != "view").alias("hit"))
    return folds.filter_changes(rows, "hit", "luma").select("clip_id", "n", "reason")


@query(
    f"""WITH RECURSIVE {SEQ}, f AS (SELECT clip_id, n, CAST(1 AS BIGINT) AS work, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS long FROM seq WHERE n = 0
  UNION ALL SELECT clip_id, n, CASE WHEN w >= 10 THEN 5 ELSE w END, CASE WHEN w >= 10 THEN w - 5 ELSE 0 END, CASE WHEN w >= 10 THEN least(long + w - 5, 24) ELSE long END
  FROM (SELECT s.clip_id, s.n, f.long, f.work + CASE WHEN s.n % 5 = 0 OR s.flag THEN 1 ELSE 0 END AS w FROM f JOIN seq s ON s.clip_id = f.clip_id AND s.n = f.n + 1))
SELECT clip_id, n, work, moved, long FROM f"""
)
def two_memories_fold(spark, sf_dir):
    """Sizes of a working and a long-term memory as rows come."""
    rows = series(spark, sf_dir).select("clip_id", "n", "flag")
    return folds.two_memories(rows).select("clip_id", "n", "work", "moved", "long")


def _repaired(weights: list[int]) -> str:
    half, out = len(weights) // 2, []
    for i, w in enumerate(weights):
        k = i - half
        pale = f"coalesce({'lead' if k > 0 else 'lag'}(luma < 0.05, {abs(k)}) OVER ({_W}), false)"
        v = _at("luma", k)
        out.append(f"(CASE WHEN {pale} OR abs({v} - luma) > 0.4 THEN luma ELSE {v} END) * {w}" if k else f"luma * {w}")
    return " + ".join(out)


@query(f"WITH {SEQ} SELECT clip_id, n, {r4(f'({_repaired([20] * 5)}) / 100')} AS smooth FROM seq")
def chroma_stabilizer(spark, sf_dir):
    """Centred mean whose gray or far neighbours are repaired first."""
    smooth = t.repaired_average("luma", t.even_weights(5), F.col("luma") < 0.05, 0.4)
    return series(spark, sf_dir).select("clip_id", "n", half_up(smooth).alias("smooth"))
