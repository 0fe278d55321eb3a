"""Queries over whole planes whose size grows with the data, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up
from tidemark.operators import planes
from tidemark.plans.common import PX, r4, registry
from tidemark.sources.series import plane_cells

QUERIES, ORACLES, query = registry()

_PL = (
    "pl AS (SELECT CAST(line AS BIGINT) AS plane, k % 128 AS x, k // 128 AS y, r AS v, r2 AS w FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY row_id, p, s) - 1 AS k, "
    "count(*) OVER (PARTITION BY line) AS n FROM px) WHERE k // 128 < n // 128)"
)
_ROW, _COLUMN = ("OVER (PARTITION BY plane, y ORDER BY x)", "OVER (PARTITION BY plane, x ORDER BY y)")
#: The eight cells around each one, clockwise from the upper left; beyond the plane its edge goes on.
_AROUND = (
    f"b AS (SELECT plane, x, y, v, coalesce(lag(v) {_ROW}, v) AS l, coalesce(lead(v) {_ROW}, v) AS r FROM pl), a AS (SELECT plane, x, y, v AS c8, l AS c7, r AS c3, "
    + ", ".join(f"coalesce({f}({c}) {_COLUMN}, {c}) AS c{i}" for i, f, c in ((0, "lag", "l"), (1, "lag", "v"), (2, "lag", "r"), (4, "lead", "r"), (5, "lead", "v"), (6, "lead", "l")))
    + " FROM b)"
)


def _compass(turn: int) -> str:
    return "abs(" + " + ".join(f"c{i} * {5 if (i - turn) % 8 < 3 else -3}" for i in range(8)) + ")"


@query(f"WITH {PX}, {_PL}, {_AROUND} SELECT plane, x, y, least(greatest({', '.join(_compass(t) for t in (0, 2, 4, 6))}), 255) AS v FROM a")
def plane_kirsch(spark, sf_dir):
    """Largest of four edge kernels on whole planes."""
    return planes.edges(plane_cells(spark, sf_dir))


@query(f"WITH {PX}, {_PL}, {_AROUND} SELECT plane, x, y, CAST(list_sort([{', '.join(f'c{i}' for i in range(9))}])[5] AS DOUBLE) AS v FROM a")
def plane_median(spark, sf_dir):
    """Medians of 3 x 3 cells on whole planes."""
    return planes.median(plane_cells(spark, sf_dir))


_BOX = [("a", "v"), ("b", "w"), ("aa", "v * v"), ("bb", "w * w"), ("ab", "v * w")]


@query(
    f"""WITH {PX}, {_PL}, q AS (SELECT plane, x, y, {", ".join(f"{e} AS {n}" for n, e in _BOX)} FROM pl),
h AS (SELECT plane, x, y, max(x) OVER (PARTITION BY plane) AS mx, max(y) OVER (PARTITION BY plane) AS my,
  {", ".join(f"sum({n}) OVER (PARTITION BY plane, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS {n}" for n, _ in _BOX)} FROM q),
k AS (SELECT plane, x, y, mx, my, {", ".join(f"sum({n}) OVER (PARTITION BY plane, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 49::DOUBLE AS {n}" for n, _ in _BOX)} FROM h),
s AS (SELECT plane, ((2 * a * b + 6.5025::DOUBLE) * (2 * (ab - a * b) * 49 / 48 + 58.5225::DOUBLE)) / ((a * a + b * b + 6.5025::DOUBLE) * ((aa - a * a + bb - b * b) * 49 / 48 + 58.5225::DOUBLE)) AS s
  FROM k WHERE x BETWEEN 3 AND mx - 3 AND y BETWEEN 3 AND my - 3)
SELECT plane, {r4("avg(s)")} AS ssim FROM s GROUP BY plane"""
)
def plane_ssim(spark, sf_dir):
    """Structural similarity of two values of whole planes."""
    return planes.ssim(plane_cells(spark, sf_dir)).select("plane", half_up(F.col("ssim")).alias("ssim"))


@query()
def plane_clahe(spark, sf_dir):
    """Whole planes equalised by 8 x 8 parts."""
    return planes.clahe(plane_cells(spark, sf_dir))


@query()
def plane_retinex(spark, sf_dir):
    """Multi-scale Retinex of whole planes."""
    return planes.retinex(plane_cells(spark, sf_dir))


@query()
def plane_canny(spark, sf_dir):
    """Thin edges of whole planes."""
    return planes.canny(plane_cells(spark, sf_dir), 300.0, 600.0)


@query()
def plane_local_average(spark, sf_dir):
    """Second values averaged over the neighbours whose first values are most alike."""
    return planes.local_average(plane_cells(spark, sf_dir))


def _resampled(matrix: np.ndarray, outside: str, w: str = "ww", h: str = "hh") -> str:
    """SQL of ``planes.resampled``."""
    a, b, c = (f"({float(m[0])!r}::DOUBLE * u + {float(m[1])!r}::DOUBLE * v + {float(m[2])!r}::DOUBLE)" for m in matrix)
    sx, sy = f"(({a} / {c} + 1) / 2 * ww - 0.5)", f"(({b} / {c} + 1) / 2 * hh - 0.5)"
    if outside == "border":
        sx, sy = f"greatest(0.0, least({sx}, ww - 1))", f"greatest(0.0, least({sy}, hh - 1))"
    return f"""z AS (SELECT plane, max(x) + 1 AS ww, max(y) + 1 AS hh FROM pl GROUP BY plane), o AS (SELECT plane, ww, hh, {w} AS w, {h} AS h, unnest(range({h})) AS y FROM z),
g AS (SELECT *, unnest(range(w)) AS x FROM o), q AS (SELECT *, (x * 2 + 1) / w::DOUBLE - 1 AS u, (y * 2 + 1) / h::DOUBLE - 1 AS v FROM g), s AS (SELECT plane, x, y, {sx} AS sx, {sy} AS sy FROM q),
k AS (SELECT s.plane, s.x, s.y, CAST(floor(sx) AS BIGINT) + i AS cx, CAST(floor(sy) AS BIGINT) + j AS cy,
  (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS part FROM s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT k.plane, k.x, k.y, {r4("sum(part * coalesce(pl.v, 0)) + 1e-7::DOUBLE", 3)} AS v FROM k LEFT JOIN pl ON pl.plane = k.plane AND pl.x = k.cx AND pl.y = k.cy GROUP BY ALL"""


_TURN = planes.rotation(10.0) @ planes.zoom(1.25, 0.3, 0.6)
_WARP = planes.perspective([(-1.0, -1.0), (-0.8, 0.9), (1.1, -0.9), (0.9, 1.0)])
_SAME = np.eye(3)


def _rounded(df):
    return df.withColumn("v", half_up(F.col("v") + 1e-7, 3))  # sums in either order round alike


@query(f"WITH {PX}, {_PL}, {_resampled(_TURN, 'zeros')}")
def plane_rotate_zoom(spark, sf_dir):
    """Whole planes turned by ten degrees and enlarged."""
    return _rounded(planes.resampled(plane_cells(spark, sf_dir), _TURN))


@query(f"WITH {PX}, {_PL}, {_resampled(_WARP, 'border')}")
def plane_warp(spark, sf_dir):
    """Whole planes seen in perspective."""
    return _rounded(planes.resampled(plane_cells(spark, sf_dir), _WARP, outside="border"))


@query(f"WITH {PX}, {_PL}, {_resampled(_SAME, 'border', '96', '64')}")
def plane_resize(spark, sf_dir):
    """Whole planes brought to one size."""
    return _rounded(planes.resampled(plane_cells(spark, sf_dir), _SAME, 96, 64, "border"))


@query(
    f"""WITH {PX}, {_PL}, z AS (SELECT plane, max(x) + 1 AS ww, max(y) + 1 AS hh FROM pl GROUP BY plane)
SELECT pl.plane, x, y, CASE WHEN (abs(x - floor(0.25 * ww)) <= 5 AND abs(y - floor(0.5 * hh)) <= 5) OR (abs(x - floor(0.7 * ww)) <= 5 AND abs(y - floor(0.4 * hh)) <= 5) THEN 0 ELSE v END AS v FROM pl JOIN z USING (plane)"""
)
def plane_cutout(spark, sf_dir):
    """Two squares of each plane set to 0."""
    return planes.cut_out(plane_cells(spark, sf_dir), [(0.25, 0.5), (0.7, 0.4)], 10)


@query(
    f"""WITH {PX}, {_PL} SELECT a.plane, a.x, a.y, {r4("CASE WHEN b.plane IS NULL THEN a.v ELSE a.v * (1 - b.v / 255::DOUBLE * 0.6::DOUBLE) + abs(a.v - b.w) * (b.v / 255::DOUBLE * 0.6::DOUBLE) END + 1e-7::DOUBLE", 3)} AS v
FROM pl a LEFT JOIN pl b ON b.plane = a.plane AND b.x = a.x - 5 AND b.y = a.y + 3"""
)
def plane_overlay(spark, sf_dir):
    """Second values laid over first ones, moved, masked and half seen through."""
    cells = plane_cells(spark, sf_dir)
    top = cells.select("plane", "x", "y", F.col("w").alias("v"), F.col("v").alias("mask"))
    return _rounded(planes.overlaid(cells, top, 5, -3, 0.6, "difference", "mask"))
