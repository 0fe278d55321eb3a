"""Registered queries over colour adjustments: ranges, tweaks, smoothers, chroma bounds, sizes, frames equalised by every method."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up
from tidemark.operators import dataset, folds, images, metrics, pixels as x, temporal
from tidemark.plans.common import PX, SEQ, r4, registry
from tidemark.plans.pixel_queries import _SAT, _a, _b, _back, _byte, _ID, _KEY, _mix, _out, _y, _yuv, _plane
from tidemark.plans.scenes import scene_detect
from tidemark.plans.presets import Preset, main, stabilised
from tidemark.sources.series import events_series, pixels, plane_samples, sample_count

QUERIES, ORACLES, query = registry()


@query(f"WITH {PX} SELECT line, {r4(f'avg(CASE WHEN {_SAT} < 200 THEN 1.0::DOUBLE ELSE 0.0 END)')} AS share, avg(CASE WHEN {_SAT} < 200 THEN 1.0::DOUBLE ELSE 0.0 END) > 0.4 AS gray FROM px GROUP BY line")
def gray_share_gate(spark, sf_dir):
    """How much of each line is pale, and whether that is too much."""
    return x.gray_share(pixels(spark, sf_dir), "line", 200, 0.4).withColumn("share", half_up(F.col("share")))


@query(f"WITH {PX} SELECT {_KEY}, {_byte('(r - 16) * 255::DOUBLE / 219 + 0.5')} AS wide, CAST(floor(r * 219 / 255::DOUBLE + 16 + 0.5) AS BIGINT) AS narrow FROM px")
def range_rescale(spark, sf_dir):
    """Samples between limited and full range."""
    return pixels(spark, sf_dir).select(*_ID, x.to_full_range(F.col("r")).alias("wide"), x.to_limited_range(F.col("r")).alias("narrow"))


_RGB_SEQ = f"{SEQ}, c AS (SELECT clip_id, n, CAST(floor(luma * 255) AS BIGINT) AS r, CAST(floor(value * 7) AS BIGINT) % 256 AS g, n * 13 % 256 AS b FROM seq)"


def _coloured(spark, sf_dir):
    s = events_series(spark, sf_dir)
    return s.select("clip_id", "n", F.floor(F.col("luma") * 255).alias("r"), (F.floor(F.col("value") * 7) % 256).alias("g"), (F.col("n") * 13 % 256).alias("b"))


_LAG = "lag({0}) OVER (PARTITION BY clip_id ORDER BY n)"
_NEARBY = ", ".join(f"coalesce({_byte(f'least(greatest({c}, {_LAG.format(c)} * 0.8::DOUBLE), least({_LAG.format(c)} * 1.2::DOUBLE, 255))')}, {c}) AS {c}" for c in "rgb")


@query(f"WITH {_RGB_SEQ} SELECT clip_id, n, CASE WHEN n = 0 THEN c.r ELSE k.r END AS r, CASE WHEN n = 0 THEN c.g ELSE k.g END AS g, CASE WHEN n = 0 THEN c.b ELSE k.b END AS b FROM c JOIN (SELECT clip_id, n, {_NEARBY} FROM c) k USING (clip_id, n)")
def rgb_smoother(spark, sf_dir):
    """Each sample within a fifth of the one before."""
    before = tuple(F.lag(c).over(temporal.by_clip()) for c in "rgb")
    return _coloured(spark, sf_dir).select("clip_id", "n", *[c.alias(k) for c, k in zip(x.smoothed_to(before, x.rgb("r", "g", "b")), "rgb")])


def _each(e: str) -> str:
    return ", ".join(f"{_byte(e.format(c))} AS {c}" for c in "rgb")


@query(
    f"""WITH {PX}, m AS (SELECT line, floor(avg({_y()}) + 0.5) AS m FROM px GROUP BY line), a AS (SELECT {_KEY}, {_each('pow({0} / 255, 1 / 1.2::DOUBLE) * 255')} FROM px),
c AS (SELECT {_KEY}, {_each('{0} * (1 + 20 / 255::DOUBLE)')} FROM a), d AS (SELECT {_KEY}, {_each('m * (1 - 1.1::DOUBLE) + {0} * 1.1::DOUBLE')} FROM c JOIN m USING (line)),
e AS (SELECT *, floor({_y()}) AS gray FROM d) SELECT {_KEY}, {_each('gray * (1 - 1.3::DOUBLE) + {0} * 1.3::DOUBLE')} FROM e"""
)
def enhance_chain(spark, sf_dir):
    """Gamma, brightness, contrast and saturation, one after another."""
    px = pixels(spark, sf_dir)
    mean = px.groupBy("line").agg(F.floor(F.avg(x.luma(_a())) + 0.5).alias("m"))
    return _out(px.join(mean, "line"), x.enhanced(_a(), gamma=1.2, bright=20, cont=1.1, sat=1.3, mean=F.col("m")), ("r", "g", "b"))


_H = """(CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0.0 ELSE ((CASE WHEN greatest(r, g, b) = r THEN (g - b) / CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE)
 WHEN greatest(r, g, b) = g THEN (b - r) / CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) + 2 ELSE (r - g) / CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) + 4 END + 6) % 6) * 30 END)"""


@query(f"WITH {PX} SELECT {_KEY}, {r4(f'({_H} + 20) % 180')} AS turned FROM px")
def hue_shift(spark, sf_dir):
    """Hues turned by forty degrees."""
    return pixels(spark, sf_dir).select(*_ID, half_up(x.hue_add(x.hue(_a()), 40)).alias("turned"))


_PICK = "[{0}][CAST(floor(six) % 6 AS BIGINT) + 1] + 0.5"


@query(
    f"""WITH {PX}, h AS (SELECT {_KEY}, CAST((floor({_H} / 180::DOUBLE * 255) + 28) % 256 AS DOUBLE) / 256 * 6 AS six, CAST({_SAT} AS DOUBLE) / 255 AS sa, CAST(greatest(r, g, b) AS DOUBLE) AS v FROM px),
k AS (SELECT *, v * (1 - sa) AS lo, v * (1 - sa * (six - floor(six))) AS dn, v * (1 - sa * (1 - (six - floor(six)))) AS up FROM h)
SELECT {_KEY}, {_byte(_PICK.format('v, dn, lo, lo, up, v'))} AS r, {_byte(_PICK.format('up, v, v, dn, lo, lo'))} AS g, {_byte(_PICK.format('lo, lo, up, v, v, dn'))} AS b FROM k"""
)
def hue_turn(spark, sf_dir):
    """Pixels with their hues turned."""
    return _out(pixels(spark, sf_dir), x.hue_turned(_a(), 40), ("r", "g", "b"))


@query(
    f"""WITH {PX}, l AS (SELECT {_KEY}, floor({_y()}) AS y FROM px), q AS (SELECT line, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM l GROUP BY line),
w AS (SELECT {_KEY}, {_byte('least(greatest((least(greatest(y, lo), hi) - lo) * 1.2::DOUBLE / (hi - lo), 0.0), 1.0) * 255')} AS y FROM l JOIN q USING (line))
SELECT {_KEY}, {_byte('pow(y / 255, 1 / 1.5::DOUBLE) * 255')} AS y FROM w"""
)
def luma_contrast(spark, sf_dir):
    """Luma stretched between percentiles, then gamma."""
    rows = pixels(spark, sf_dir).withColumn("y", F.floor(x.luma(_a())))
    marks = rows.groupBy("line").agg(F.percentile("y", F.lit(0.05)).alias("lo"), F.percentile("y", F.lit(0.95)).alias("hi"))
    return rows.join(marks, "line").select(*_ID, x.contrast(F.col("y"), F.col("lo"), F.col("hi"), 1.2, 1.5).alias("y"))


_T = _yuv()


@query(f"WITH {PX}, o AS (SELECT {_KEY}, {_back(f'floor(least(greatest({_T[0]} / 255 + 0.1::DOUBLE, 0.0), 1.0) * 255)', _T[1], _T[2])} FROM px) SELECT {_KEY}, orr AS r, og AS g, ob AS b FROM o")
def brightened(spark, sf_dir):
    """Luma raised by a tenth."""
    return _out(pixels(spark, sf_dir), x.brightened(_a(), 0.1), ("r", "g", "b"))


def _faded(w: str, t: int, step: float) -> str:
    weight = f"least(greatest(({w} - {t}) * {step}::DOUBLE, 0.0), 1.0)"
    return ", ".join(f"{_byte(f'k.{c} * (1 - {weight}) + o.{c} * {weight}')} AS {c}" for c in "rgb")


_OY = "(o.r * 0.299::DOUBLE + o.g * 0.587::DOUBLE + o.b * 0.114::DOUBLE)"


def _dark(rows: str, key: str) -> str:
    return f"""e AS (SELECT {key}, {_each('{0} * (1 + -0.8::DOUBLE / 255)')} FROM {rows}), g AS (SELECT *, floor({_y()}) AS gray FROM e),
k AS (SELECT {key}, {_each('gray * (1 - (1.1::DOUBLE - 0.8::DOUBLE)) + {0} * (1.1::DOUBLE - 0.8::DOUBLE)')} FROM g)"""


@query(f"WITH {PX}, i AS (SELECT *, row_number() OVER () AS id FROM px), {_dark('i', _KEY + ', id')} SELECT {', '.join('o.' + c for c in _ID)}, {_faded(_OY, 26, 0.02)} FROM i o JOIN k USING (id)")
def dark_tweak(spark, sf_dir):
    """Dark pixels darker and paler."""
    return _out(pixels(spark, sf_dir), x.dark_tweaked(_a(), 0.3, 0.8), ("r", "g", "b"))


@query(
    f"""WITH {PX}, i AS (SELECT *, row_number() OVER () AS id FROM px),
t AS (SELECT id, {_back(f"floor(least(greatest(({_T[0]} - 16) * 1 + -25.5::DOUBLE + 16.5, 0.0), 255.0))", f"(({_T[1]} - 128) * 0.8::DOUBLE + 128)", f"(({_T[2]} - 128) * 0.8::DOUBLE + 128)")} FROM i),
k AS (SELECT id, orr AS r, og AS g, ob AS b FROM t) SELECT {', '.join('o.' + c for c in _ID)}, {_faded(_OY, 76, 0.013)} FROM i o JOIN k USING (id)"""
)
def bright_chroma(spark, sf_dir):
    """Saturation and brightness lowered in the dark."""
    return _out(pixels(spark, sf_dir), x.bright_chroma(_a()), ("r", "g", "b"))


_GRID = ", ".join(f"min({c}) AS {c}" for c in ("r", "g", "b", "r2", "g2", "b2"))
_BOUND = [f"floor(least(greatest({n}, least(greatest({s} - tol, 0.0), 255.0)), least(greatest({s} + tol, 0.0), 255.0)))" for s, n in zip(_yuv()[1:], _yuv("2")[1:])]


@query(
    f"""WITH {PX}, g AS (SELECT s AS plane, row_id % 64 AS x, p % 48 AS y, {_GRID} FROM px GROUP BY ALL), v AS (SELECT *, floor({_y()}) AS v FROM g),
t AS (SELECT a.*, least(abs(coalesce(l.v, a.v) + coalesce(e.v, a.v) + coalesce(u.v, a.v) + coalesce(d.v, a.v) - 4 * a.v) / 255::DOUBLE, 1.0) * 18 + 14 AS tol FROM v a
 LEFT JOIN v l ON l.plane = a.plane AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN v e ON e.plane = a.plane AND e.x = a.x + 1 AND e.y = a.y LEFT JOIN v u ON u.plane = a.plane AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN v d ON d.plane = a.plane AND d.x = a.x AND d.y = a.y + 1),
o AS (SELECT plane, x, y, {_back(_T[0], *_BOUND)} FROM t) SELECT plane, x, y, orr AS r, og AS g, ob AS b FROM o"""
)
def chroma_bound(spark, sf_dir):
    """New colours within a tolerance of the stable ones that follows the luma's texture."""
    grid = [F.min(c).alias(c) for c in ("r", "g", "b", "r2", "g2", "b2")]
    plane = plane_samples(spark, sf_dir).groupBy("plane", "x", "y").agg(*grid)
    v = plane.select("plane", "x", "y", F.floor(x.luma(_a())).alias("v"))
    lap = images.laplacian(v, ("plane",), sample_count(spark, sf_dir)).select("plane", "x", "y", "laplacian")
    out = x.tolerant_chroma(_a(), _b(), x.chroma_tolerance(F.col("laplacian")))
    return plane.join(lap, ["plane", "x", "y"]).select("plane", "x", "y", *[c.alias(k) for c, k in zip(out, "rgb")])


_FIT = "CAST(round_even(w * 480 / h::DOUBLE, 0) AS BIGINT)"
_TALL = "CAST(round_even(h * 512 / w::DOUBLE, 0) AS BIGINT)"


@query(
    f"""WITH z AS (SELECT p_partkey, 100 + p_partkey * 37 % 1900 AS w, 80 + p_size::BIGINT * 30 AS h FROM part)
SELECT p_partkey, {_FIT} - {_FIT} % 2 AS fit_w, CASE WHEN h < w THEN CASE WHEN h > 480 THEN {_FIT} - {_FIT} % 2 ELSE w END ELSE CASE WHEN w > 512 THEN 512 ELSE w END END AS lim_w,
CASE WHEN h < w THEN least(h, 480) ELSE CASE WHEN w > 512 THEN {_TALL} + {_TALL} % 2 ELSE h END END AS lim_h,
CAST(floor(w * (512::DOUBLE / greatest(w, h)) / 16) * 16 AS BIGINT) AS pad_w, CAST(floor((512 - floor(h * (512::DOUBLE / greatest(w, h)) / 16) * 16) / 2) AS BIGINT) AS pad_top FROM z"""
)
def frame_sizes(spark, sf_dir):
    """Sizes of frames fitted to a height, limited, and padded into a square."""
    from tidemark.session import table

    z = table(spark, sf_dir, "part").selectExpr("p_partkey", "100 + p_partkey * 37 % 1900 AS w", "80 + cast(p_size as long) * 30 AS h")
    w, h = F.col("w"), F.col("h")
    lim, pad = x.limited_size(w, h), x.padded_size(w, h)
    return z.select("p_partkey", x.fitted_size(w, h, 480)[0].alias("fit_w"), lim[0].alias("lim_w"), lim[1].alias("lim_h"), pad[0].alias("pad_w"), pad[3].alias("pad_top"))


@query(f"WITH {PX} SELECT {_KEY}, {_byte('pow(least(greatest(' + _byte('r * 1.2::DOUBLE + 10') + ' / 255, 0.0), 1.0), 1 / 1.5::DOUBLE) * 255')} AS r FROM px")
def channel_gain(spark, sf_dir):
    """Gain, bias and gamma of a channel."""
    return pixels(spark, sf_dir).select(*_ID, x.channel_gain(F.col("r"), 1.2, 10, 1.5).alias("r"))


@query(f"WITH {PX} SELECT {_KEY}, {_mix(f'least(greatest(({_y("2")} - 51) * 0.008::DOUBLE, 0.0), 1.0)')} FROM px")
def luma_gradient_merge(spark, sf_dir):
    """The first image fading into the second as that gets brighter."""
    return _out(pixels(spark, sf_dir), x.by_luma_gradient(_a(), _b(), 0.2, 0.7))


@query(f"WITH {PX} SELECT {_KEY}, " + ", ".join(f"CASE WHEN {_SAT} < 120 THEN {c}2 ELSE {c} END AS {c}" for c in "rgb") + " FROM px")
def gray_fill(spark, sf_dir):
    """Pale pixels filled from the second image."""
    return _out(pixels(spark, sf_dir), x.gray_filled(_a(), _b(), 120), ("r", "g", "b"))


@query(f"WITH {SEQ} SELECT clip_id, n FROM seq WHERE NOT (n >= 10 AND n < 40) AND kind <> 'view'")
def sieve_range(spark, sf_dir):
    """Rows outside a range, without some kinds."""
    return dataset.drop_if(dataset.sieve(events_series(spark, sf_dir), "n", 10, 40), F.col("kind") == "view").select("clip_id", "n")


def _mean5(c: str) -> str:
    w = "OVER (PARTITION BY clip_id ORDER BY n)"
    whole = "OVER (PARTITION BY clip_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    parts = [f"coalesce(lag({c}, {k}) {w}, first_value({c}) {whole}) * 20" for k in (2, 1)] + [f"{c} * 20"] + [f"coalesce(lead({c}, {k}) {w}, last_value({c}) {whole}) * 20" for k in (1, 2)]
    return f"{_byte('(' + ' + '.join(parts) + ') / 100::DOUBLE')} AS {c}"


@query(
    f"""WITH {_RGB_SEQ}, {_dark('c', 'clip_id, n')}, f AS (SELECT clip_id, n, {_faded(_OY, 26, 0.02)} FROM c o JOIN k USING (clip_id, n)) SELECT clip_id, n, {", ".join(map(_mean5, "rgb"))} FROM f"""
)
def stabilizer_chain(spark, sf_dir):
    """Dark frames tweaked, then a centred mean over five frames."""
    return stabilised(dark=(0.3, 0.8), frames=5)(_coloured(spark, sf_dir)).select("clip_id", "n", "r", "g", "b")


@query(
    f"""WITH {PX}, i AS (SELECT row_id, line, p, s, {_mix('CAST(0.4 AS DOUBLE)').replace(' AS or', ' AS orr')} FROM px), c AS (SELECT row_id, line, p, s, orr AS r, og AS g, ob AS b, row_number() OVER () AS id FROM i),
{_dark('c', _KEY + ', id')} SELECT {', '.join('o.' + c for c in _ID)}, {_faded(_OY, 26, 0.02)} FROM c o JOIN k USING (id)"""
)
def main_preset(spark, sf_dir):
    """A named preset from speed to result: merged, then dark pixels tweaked, since the speed is very slow."""
    return _out(main(Preset(speed="veryslow"))(pixels(spark, sf_dir)), x.rgb("or", "og", "ob"), ("r", "g", "b"))


@query()
def canny_edges(spark, sf_dir):
    """Thin edges of frames of 8 x 8 samples."""
    return images.canny(images.frames(pixels(spark, sf_dir)))


@query()
def equalize_methods(spark, sf_dir):
    """Frames equalised by every method."""
    frames = images.frames(pixels(spark, sf_dir))
    out = [images.equalised_frames(frames, m).withColumn("method", F.lit(m)) for m in ("tiles", "flat", "mix", "table")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    f"""WITH {PX}, g AS (SELECT s AS plane, row_id % 64 AS x, p % 48 AS y, min(r) AS v FROM px GROUP BY ALL)
SELECT a.plane, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS variation, count(*) AS n FROM g a JOIN g b ON a.plane = b.plane AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY a.plane"""
)
def plane_variation(spark, sf_dir):
    """How much each plane changes from place to place."""
    return metrics.total_variation(_plane(spark, sf_dir), by=("plane",))


@query(f"WITH {SEQ} SELECT clip_id, n, CASE WHEN n = 0 OR flag THEN luma * 0.5 ELSE luma END AS luma FROM seq")
def scene_gate(spark, sf_dir):
    """A change of luma at flagged rows alone."""
    gated = temporal.gated(F.col("luma") * 0.5, F.col("luma"), F.col("flag"))
    return events_series(spark, sf_dir).select("clip_id", "n", gated.alias("luma"))


@query(f"WITH {SEQ} SELECT clip_id, n, {r4('CASE WHEN flag THEN luma ELSE luma * (1 - 0.3::DOUBLE) + value / 1000 * 0.3::DOUBLE END')} AS merged FROM seq")
def ref_merge(spark, sf_dir):
    """Predictions blended into references but at reference rows."""
    merged = temporal.reference_merged(F.col("luma"), F.col("value") / 1000, F.col("flag"), 0.3)
    return events_series(spark, sf_dir).select("clip_id", "n", half_up(merged).alias("merged"))


@query(
    f"""WITH RECURSIVE {SEQ}, f AS (SELECT clip_id, n, luma AS last, luma AS ref FROM seq WHERE n = 0
  UNION ALL SELECT s.clip_id, s.n, CASE WHEN s.flag THEN s.luma ELSE s.luma * 0.5::DOUBLE + f.last * 0.25::DOUBLE + f.ref * 0.25::DOUBLE END, CASE WHEN s.flag THEN s.luma ELSE f.ref END
  FROM f JOIN seq s ON s.clip_id = f.clip_id AND s.n = f.n + 1) SELECT clip_id, n, {r4('last')} AS colour FROM f"""
)
def exemplar_propagation(spark, sf_dir):
    """Colours carried on from the last prediction and the last reference."""
    rows = folds.propagate(events_series(spark, sf_dir).select("clip_id", "n", "luma", "flag"), "luma", "flag", lambda v, last, ref: v * 0.5 + last * 0.25 + ref * 0.25)
    return rows.select("clip_id", "n", half_up(F.col("colour")).alias("colour"))


@query(
    f"""WITH {SEQ}, d AS (SELECT clip_id, n, luma, greatest({r4('abs(luma - coalesce(lag(luma) OVER (PARTITION BY clip_id ORDER BY n), luma))', 5)}, 0.0001) AS diff FROM seq)
SELECT clip_id, n, n = 0 OR ((diff > 0.25 OR n % 12 = 0) AND luma > 0.02 AND luma < 0.98) AS change, n = 0 OR n % 7 = 0 AS often, false AS never FROM d"""
)
def scene_dispatch(spark, sf_dir):
    """Changes by difference and frequency, by frequency alone, and by neither."""
    s = events_series(spark, sf_dir).select("clip_id", "n", "luma")
    a = scene_detect(s, 0.25, 12, black=0.02, white=0.98)
    b = scene_detect(a.withColumnRenamed("change", "first"), 0, 7).withColumnRenamed("change", "often")
    return scene_detect(b, 0, 0).select("clip_id", "n", F.col("first").alias("change"), "often", F.col("change").alias("never"))


_STATS = ", ".join(f"{r4(f'avg({a}) / 255', 5)} AS mean_{a}, greatest({r4(f'avg(abs({a} - {a}2)) / 255', 5)}, 0.0001) AS diff_{a}" for a in "rgb")


@query(f"WITH {PX} SELECT line, {_STATS} FROM px GROUP BY line")
def plane_stats(spark, sf_dir):
    """Means of all planes and their differences from the second image."""
    return images.plane_stats(pixels(spark, sf_dir), "line", (("r", "r2"), ("g", "g2"), ("b", "b2")))


@query(
    f"""WITH {PX}, i AS (SELECT line, p % 5 AS part, r // 2 AS r, r2 FROM px), m AS (SELECT line, part, floor(avg(r)) AS ma, floor(avg(r2)) AS mb FROM i GROUP BY ALL)
SELECT line, part, {r4("avg(abs(least(greatest(r + greatest(mb - ma, 0), 0), 255) - least(greatest(r2 + greatest(ma - mb, 0), 0), 255))) / 255")} AS distance FROM i JOIN m USING (line, part) GROUP BY line, part"""
)
def pixel_distance(spark, sf_dir):
    """Mean distances of aligned planes."""
    rows = pixels(spark, sf_dir).select("line", (F.col("p") % 5).alias("part"), F.floor(F.col("r") / 2).alias("r"), "r2")
    return images.pixel_distance(rows, ["line", "part"], "r", "r2")


@query(
    f"""WITH {PX}, g AS (SELECT s AS plane, row_id % 64 AS x, p % 48 AS y, min(r) AS v FROM px GROUP BY ALL), h AS (SELECT unnest([0, 1]) AS i),
w AS (SELECT plane, x, y, v, CASE WHEN a.i = 0 THEN least(1.0, (36 - x) / 8) ELSE least(1.0, (x - 27) / 8) END * CASE WHEN b.i = 0 THEN least(1.0, (28 - y) / 8) ELSE least(1.0, (y - 19) / 8) END AS w FROM g, h a, h b
  WHERE CASE WHEN a.i = 0 THEN x < 36 ELSE x >= 28 END AND CASE WHEN b.i = 0 THEN y < 28 ELSE y >= 20 END)
SELECT plane, x, y, {r4("sum(v * w) / sum(w)")} AS v, count(*) AS tiles FROM w GROUP BY plane, x, y"""
)
def tile_grid(spark, sf_dir):
    """Planes cut into two by two tiles and put together."""
    return images.join_tiles(images.split_grid(_plane(spark, sf_dir), 64, 48, 4, ("plane",)), ("plane",))


@query(f"WITH {PX}, m AS (SELECT line, avg(r) AS ma, stddev_samp(r) AS sa, avg(r2) AS mb, stddev_samp(r2) AS sb FROM px GROUP BY line) SELECT {', '.join('px.' + c for c in _ID)}, {r4('(r - ma) / sa * sb + mb')} AS matched FROM px JOIN m USING (line)")
def match_statistics(spark, sf_dir):
    """A channel with the mean and deviation of another."""
    return images.matched(pixels(spark, sf_dir), "line", "r", "r2").select(*_ID, half_up(F.col("matched")).alias("matched"))


@query(f"WITH {PX} SELECT line, {r4('sum(abs(r - r2) * g) / sum(g)')} AS l1, {r4('sum(CAST(r - r2 AS DOUBLE) * (r - r2) * g) / sum(g)')} AS l2, {r4('1 - sum(r * r2) / sqrt(sum(r * r)::DOUBLE * sum(r2 * r2)::DOUBLE)')} AS cosine_distance FROM px GROUP BY line")
def weighted_errors(spark, sf_dir):
    """Errors of a channel weighted by another, and the cosine distance."""
    out = metrics.weighted_errors(pixels(spark, sf_dir), ["line"], "r", "r2", "g")
    return out.select("line", *[half_up(F.col(c)).alias(c) for c in ("l1", "l2", "cosine_distance")])


@query(f"WITH {PX} SELECT {_KEY}, {r4(_H)} AS hue, {r4(_SAT)} AS saturation, greatest(r, g, b) AS value FROM px")
def hsv_space(spark, sf_dir):
    """Hue, saturation and value of each pixel."""
    return _out(pixels(spark, sf_dir), (half_up(x.hue(_a())), half_up(x.saturation(_a())), F.greatest(*_a())), ("hue", "saturation", "value"))


@query(f"WITH {PX}, g AS (SELECT s AS plane, row_id % 64 AS x, p % 48 AS y, min(r) AS v FROM px GROUP BY ALL) SELECT plane, 47 - y AS x, x AS y, v FROM g")
def rotate_plane(spark, sf_dir):
    """Planes turned by a quarter."""
    return images.rotated(_plane(spark, sf_dir), 48)


@query(f"""WITH {SEQ}, k AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS size FROM seq)
SELECT clip_id, n FROM k WHERE size <= 40 OR n < 5 OR n >= size - 3""")
def sieve_long_clips(spark, sf_dir):
    """Rows outside a range that ends three rows before the last, in clips of more than 40 rows."""
    return dataset.sieve(events_series(spark, sf_dir), "n", 5, -3, "clip_id", 40).select("clip_id", "n")
