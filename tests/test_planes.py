"""Neighbourhoods on large planes against numpy on whole planes, cut at several tile sizes."""

import numpy as np
import pytest

from tidemark.operators import images, planes

SIZES = [(256, 256), (64, 48), (100, 333)]


@pytest.fixture(scope="module")
def whole():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:150, :210]
    smooth = 110 + 70 * np.sin(x / 9) * np.cos(y / 13) + 30 * (x > 100) + 20 * (y > 60)
    v = np.clip(smooth + rng.normal(0, 6, smooth.shape), 0, 255).astype(int)
    small = rng.integers(0, 256, (5, 3))
    return {1: (v, np.clip(v + rng.integers(-20, 20, v.shape), 0, 255)), 7: (small, small[::-1].copy())}


def as_cells(spark, planes_):
    rows = [(p, int(x), int(y), float(v[y, x]), float(w[y, x])) for p, (v, w) in planes_.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "plane long, x long, y long, v double, w double").repartition(6)


@pytest.fixture(scope="module")
def cells(spark, whole):
    return as_cells(spark, whole).cache()


def grids(df, column="v"):
    rows = df.select("plane", "x", "y", column).toPandas()
    assert not rows.duplicated(["plane", "x", "y"]).any()
    out = {}
    for p, part in rows.groupby("plane"):
        out[p] = np.full((part.y.max() + 1, part.x.max() + 1), np.nan)
        out[p][part.y, part.x] = part[column]
    return out


@pytest.mark.parametrize("size", SIZES)
def test_edges_and_medians(cells, whole, size):
    got, mid = grids(planes.edges(cells, size)), grids(planes.median(cells, 2, size))
    for p, (v, _) in whole.items():
        w = np.lib.stride_tricks.sliding_window_view(np.pad(v, 1, mode="edge"), (3, 3))
        want = np.minimum(np.max([np.abs((w * k).sum((2, 3))) for k in images.compass_kernels()], axis=0), 255)
        assert (got[p] == want).all()
        five = np.lib.stride_tricks.sliding_window_view(np.pad(v, 2, mode="edge"), (5, 5))
        assert (mid[p] == np.median(five, axis=(2, 3))).all()


@pytest.mark.parametrize("size", SIZES)
def test_ssim(cells, whole, size):
    got = {r.plane: r.ssim for r in planes.ssim(cells, size=size).collect()}
    assert list(got) == [1]  # the other is smaller than a window
    assert got[1] == pytest.approx(images.ssim(whole[1][0][None].astype(float), whole[1][1][None].astype(float))[0], abs=1e-9)


def test_large_plane(spark):
    from pyspark.sql import functions as F

    v = lambda x, y: (x * 7 + y * 13 + x * y) % 256
    df = spark.range(1000 * 700).select(F.lit(3).cast("long").alias("plane"), (F.col("id") % 1000).alias("x"), F.expr("id div 1000").alias("y"))
    df = df.withColumns({"v": v(F.col("x"), F.col("y")).cast("double"), "w": ((F.col("x") * 5 + F.col("y")) % 256).cast("double")})
    y, x = np.mgrid[:700, :1000]
    a, b = v(x, y).astype(float), ((x * 5 + y) % 256).astype(float)
    want = images.ssim(a[None], b[None])[0]
    assert [r.ssim for size in SIZES for r in planes.ssim(df, size=size).collect()] == pytest.approx([want] * 3, abs=1e-9)


@pytest.mark.parametrize("strip", [1024, 37])
def test_retinex(cells, whole, strip):
    sigmas = (1.0, 4.0, 15.0)
    got = grids(planes.retinex(cells, sigmas, strip))
    for p, (v, _) in whole.items():
        m = 0
        for s in sigmas:
            k = planes.gaussian(s)
            blur = v.astype(float)
            for axis in (1, 0):
                r = len(k) // 2
                padded = np.pad(blur, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
                blur = np.lib.stride_tricks.sliding_window_view(padded, len(k), axis) @ k
            m = m + (np.log1p(v) - np.log(blur + 1)) / len(sigmas)
        want = np.floor((m - m.min()) / (m.max() - m.min()) * 255)
        assert (np.abs(got[p] - want) <= 1).all() and (got[p] != want).mean() < 0.001  # a floor may fall on either side


@pytest.mark.parametrize("size", SIZES)
def test_clahe(cells, whole, size):
    got = grids(planes.clahe(cells, 2.0, 8, size))
    for p, (v, _) in whole.items():
        (h, w), grid = v.shape, 8
        th, tw = -(-h // grid), -(-w // grid)
        ny, nx = -(-h // th), -(-w // tw)
        table = np.zeros((ny, nx, 256))
        for i in range(ny):
            for j in range(nx):
                part = v[i * th : (i + 1) * th, j * tw : (j + 1) * tw]
                n = np.bincount(part.ravel(), minlength=256).astype(float)
                top = max(1, int(2.0 * part.size / 256))
                n = np.minimum(n, top) + np.maximum(n - top, 0).sum() / 256
                table[i, j] = np.clip(np.floor(np.cumsum(n) * 255 / part.size + 0.5), 0, 255)
        for _ in range(400):
            y, x = np.random.randint(h), np.random.randint(w)
            fy, fx = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            at = lambda i, j: table[min(max(i, 0), ny - 1), min(max(j, 0), nx - 1), v[y, x]]
            a, b = fy - y0, fx - x0
            want = (at(y0, x0) * (1 - b) + at(y0, x0 + 1) * b) * (1 - a) + (at(y0 + 1, x0) * (1 - b) + at(y0 + 1, x0 + 1) * b) * a
            assert got[p][y, x] == np.floor(want + 0.5)


@pytest.mark.parametrize("size", [(256, 256), (40, 25)])
def test_canny(cells, whole, size):
    got = grids(planes.canny(cells, 60.0, 200.0, size))
    for p, (v, _) in whole.items():
        w = np.lib.stride_tricks.sliding_window_view(np.pad(v, 1, mode="edge"), (3, 3))
        sobel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
        gx, gy = (w * sobel).sum((2, 3)), (w * sobel.T).sum((2, 3))
        strength = np.abs(gx) + np.abs(gy)
        around = np.pad(strength, 1)
        thin = np.zeros_like(strength)
        for y in range(v.shape[0]):
            for x in range(v.shape[1]):
                way = int((np.degrees(np.arctan2(gy[y, x], gx[y, x])) % 180 + 22.5) // 45) % 4
                i, j = [(0, 1), (1, 1), (1, 0), (1, -1)][way]
                if strength[y, x] > around[y + 1 - i, x + 1 - j] and strength[y, x] >= around[y + 1 + i, x + 1 + j]:
                    thin[y, x] = strength[y, x]
        kept, todo = thin > 200, list(zip(*np.nonzero(thin > 200)))
        while todo:
            y, x = todo.pop()
            for i in range(max(y - 1, 0), min(y + 2, v.shape[0])):
                for j in range(max(x - 1, 0), min(x + 2, v.shape[1])):
                    if thin[i, j] > 60 and not kept[i, j]:
                        kept[i, j] = True
                        todo.append((i, j))
        assert ((got[p] == 255) == kept).all()


@pytest.mark.parametrize("size", [(256, 256), (33, 47)])
def test_local_average(cells, whole, size):
    got = grids(planes.local_average(cells, radius=2, k=6, size=size))
    for p, (v, w) in whole.items():
        for y, x in {(0, 0), (v.shape[0] - 1, v.shape[1] - 1), *[(int(a * 977) % v.shape[0], int(a * 313) % v.shape[1]) for a in range(200)]}:
            near = [(i, j) for i in range(y - 2, y + 3) for j in range(x - 2, x + 3) if 0 <= i < v.shape[0] and 0 <= j < v.shape[1]]
            best = sorted(near, key=lambda c: (v[c] - v[y, x]) ** 2)[:6]
            e = [np.exp(-0.01 * float(v[c] - v[y, x]) ** 2) for c in best]
            assert got[p][y, x] == pytest.approx(sum(a * w[c] for a, c in zip(e, best)) / sum(e))


def test_missing_cells_and_no_cells(spark, cells):
    some = cells.where("plane = 7 and not (x = 1 and y = 1)")
    assert planes.median(some, 1).count() == 14
    assert planes.edges(cells.limit(0)).count() == 0 and planes.canny(cells.limit(0)).count() == 0 and planes.clahe(cells.limit(0)).count() == 0


def seen(v, matrix, width, height, outside):
    """Bilinear samples one place at a time."""
    h, w = v.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            a, b, c = matrix @ np.array([(2 * x + 1) / width - 1, (2 * y + 1) / height - 1, 1])
            sx, sy = (a / c + 1) / 2 * w - 0.5, (b / c + 1) / 2 * h - 0.5
            total = 0.0
            for i in (int(np.floor(sx)), int(np.floor(sx)) + 1):
                for j in (int(np.floor(sy)), int(np.floor(sy)) + 1):
                    part = (1 - abs(sx - i)) * (1 - abs(sy - j))
                    if outside == "border":
                        total += part * v[min(max(j, 0), h - 1), min(max(i, 0), w - 1)]
                    elif outside == "reflection":
                        k, m = i % (2 * w), j % (2 * h)
                        total += part * v[m if m < h else 2 * h - 1 - m, k if k < w else 2 * w - 1 - k]
                    elif 0 <= i < w and 0 <= j < h:
                        total += part * v[j, i]
            out[y, x] = total
    return out


@pytest.mark.parametrize("outside, size", [("zeros", None), ("border", (40, 31)), ("reflection", None)])
def test_resampling(cells, whole, outside, size):
    rng = np.random.default_rng(9)
    for matrix in (planes.rotation(33.0) @ planes.zoom(0.7, 0.2, 0.9), planes.perspective([tuple(p + rng.uniform(-0.2, 0.2, 2)) for p in np.array([(-1, -1), (-1, 1), (1, -1), (1, 1)])])):
        got = grids(planes.resampled(cells, matrix, *(size or (None, None)), outside=outside))
        for p, (v, _) in whole.items():
            want = seen(v, matrix, *(size or v.shape[::-1]), outside)
            assert got[p].shape == want.shape and np.abs(got[p] - want).max() < 1e-6


def test_matrices_and_holes(cells, whole):
    moved = [(-0.9, -1.1), (-1.2, 0.8), (1.0, -0.7), (1.1, 1.3)]
    m = planes.perspective(moved)
    for corner, to in zip([(-1, -1), (-1, 1), (1, -1), (1, 1)], moved):
        a, b, c = m @ np.array([*corner, 1])
        assert (a / c, b / c) == pytest.approx(to)
    v = grids(planes.cut_out(cells, [(0.0, 0.0), (0.5, 0.5)], 6))[1]
    want = whole[1][0].copy()
    want[:4, :4] = 0
    want[75 - 3 : 75 + 4, 105 - 3 : 105 + 4] = 0
    assert (v == want).all()
    with pytest.raises(ValueError):
        planes.resampled(cells, m, outside="other")


def test_overlays_are_placed(cells, whole):
    got = grids(planes.overlaid(cells, cells.selectExpr("plane", "x", "y", "w AS v", "w AS m"), -4, 2, 0.5, "normal", "m"))
    for p, (v, w) in whole.items():
        want = v.astype(float)
        for y in range(v.shape[0]):
            for x in range(v.shape[1]):
                if 0 <= y - 2 and x + 4 < v.shape[1]:
                    part = w[y - 2, x + 4] / 255 * 0.5
                    want[y, x] = v[y, x] * (1 - part) + w[y - 2, x + 4] * part
        assert np.abs(got[p] - want).max() < 1e-9
