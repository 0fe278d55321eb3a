"""Neighbourhoods on planes of any size.

A plane is a set of cells (plane, x, y and values), a dense rectangle from (0, 0) on. ``neighbourhood`` cuts planes into tiles and
sends each cell to every tile whose border it touches, so that a tile holds a halo of its neighbours' cells; a numpy kernel
runs on one tile at a time. A task holds a tile, never a plane. Kernels that are wide in one direction run as two passes over
strips, and what needs a whole plane (histograms, extremes) is an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.images import compass_kernels
from tidemark.operators.pixels import overlay
from tidemark.session import staged

SIZE = (256, 256)
STRIP = 1024
#: Planes of at most this width are blurred by tiles as wide as they are, of so many rows.
NARROW, ROWS = 256, 2048


def extents(cells: DataFrame) -> DataFrame:
    """plane, width and height, one row a plane."""
    size = lambda c: (F.max(c) + 1).cast("long")
    return cells.groupBy("plane").agg(size("x").alias("width"), size("y").alias("height"))


def _tile(row: dict, cells: pa.StructArray, values: tuple[str, ...], halo: tuple[int, int], size: tuple[int, int], outside: float | None):
    """(own cells present, blocks with halo, place) of one tile, or None if it lies outside the plane."""
    (hx, hy), x0, y0 = halo, row["tx"] * size[0], row["ty"] * size[1]
    w, h = min(size[0], row["width"] - x0), min(size[1], row["height"] - y0)
    if w <= 0 or h <= 0:
        return None
    left, top = max(0, x0 - hx), max(0, y0 - hy)
    right, bottom = min(row["width"], x0 + w + hx), min(row["height"], y0 + h + hy)
    x, y = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    near = (x >= left) & (x < right) & (y >= top) & (y < bottom)
    at = (y[near] - top, x[near] - left)
    pad = ((hy - (y0 - top), hy - (bottom - y0 - h)), (hx - (x0 - left), hx - (right - x0 - w)))
    blocks, there = [], np.zeros((bottom - top, right - left), bool)
    there[at] = True
    for c in values:
        block = np.zeros(there.shape)
        block[at] = cells.field(c).to_numpy(zero_copy_only=False)[near]
        blocks.append(np.pad(block, pad, mode="edge") if outside is None else np.pad(block, pad, constant_values=outside))
    own = there[y0 - top : y0 - top + h, x0 - left : x0 - left + w]
    return own, blocks, {"x0": x0, "y0": y0, "width": row["width"], "height": row["height"], "context": row.get("context")}


def neighbourhood(
    cells: DataFrame,
    kernel: Callable[[list[np.ndarray], dict], list[np.ndarray]],
    out: dict[str, str],
    halo: tuple[int, int],
    size: tuple[int, int] = SIZE,
    values: tuple[str, ...] = ("v",),
    outside: float | None = None,
    whole: DataFrame | None = None,
) -> DataFrame:
    """plane, x, y and the columns ``out``: what ``kernel`` makes of each tile.

    The kernel gets a block a value, larger than the tile by ``halo`` on each side (beyond the plane its edge goes on, or
    ``outside``), and the tile's place; it returns an array of the tile's size for each column. ``whole`` has a row a plane:
    width, height and, where a kernel needs it, ``context``. Cells that are missing count as 0 and give no row.
    """
    whole = extents(cells) if whole is None else whole
    near = lambda c, h, s: F.sequence(F.greatest(F.floor((F.col(c) - h) / s), F.lit(0)).cast("long"), F.floor((F.col(c) + h) / s).cast("long"))
    sent = cells.select("plane", F.explode(near("x", halo[0], size[0])).alias("tx"), "x", "y", *values)
    sent = sent.select("plane", "tx", F.explode(near("y", halo[1], size[1])).alias("ty"), "x", "y", *values)
    held = sent.groupBy("plane", "tx", "ty").agg(F.collect_list(F.struct("x", "y", *values)).alias("cells"))  # a tile and its halo
    kinds = {"double": pa.float64(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.drop_columns(["cells"]).to_pylist()
            for row, held in zip(rows, b.column("cells")):
                tile = _tile(row, held.values, values, halo, size, outside)
                if tile is None:
                    continue
                own, blocks, place = tile
                y, x = np.nonzero(own)
                made = kernel(blocks, place)
                arrays = [pa.array(m[own].astype(kinds[t].to_pandas_dtype()), kinds[t]) for m, t in zip(made, out.values())]
                keys = [np.full(len(x), row["plane"]), x + place["x0"], y + place["y0"]]
                yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys], *arrays], ["plane", "x", "y", *out])

    form = "plane long, x long, y long, " + ", ".join(f"{c} {t}" for c, t in out.items())
    return held.join(whole, "plane").mapInArrow(run, form)


def _shifted(x: np.ndarray, k: int, axis: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums over k successive places along an axis."""
    n = x.shape[axis] - k + 1
    part = lambda j: x[:, j : j + n] if axis else x[j : j + n]
    return sum(part(j) if weights is None else part(j) * weights[j] for j in range(k))


def ssim(cells: DataFrame, a: str = "v", b: str = "w", k: int = 7, size: tuple[int, int] = SIZE) -> DataFrame:
    """plane and ssim: mean structural similarity of two values over the uniform windows that lie inside the plane."""
    n, c1, c2 = k * k, (0.01 * 255) ** 2, (0.03 * 255) ** 2
    box = lambda x: _shifted(_shifted(x, k, 0), k, 1) / n

    def kernel(blocks: list[np.ndarray], place: dict) -> list[np.ndarray]:
        p, q = blocks
        mp, mq = box(p), box(q)
        vp, vq, cov = ((box(s * t) - ms * mt) * n / (n - 1) for s, t, ms, mt in ((p, p, mp, mp), (q, q, mq, mq), (p, q, mp, mq)))
        return [((2 * mp * mq + c1) * (2 * cov + c2)) / ((mp**2 + mq**2 + c1) * (vp + vq + c2))]

    found = neighbourhood(cells, kernel, {"s": "double"}, (k // 2, k // 2), size, (a, b), np.nan)
    return found.where(~F.isnan("s")).groupBy("plane").agg(F.avg("s").alias("ssim"))


def median(cells: DataFrame, radius: int = 1, size: tuple[int, int] = SIZE) -> DataFrame:
    """``v``: the median of a square around each cell; the plane's edge goes on."""

    def kernel(blocks: list[np.ndarray], place: dict) -> list[np.ndarray]:
        return [np.median(np.lib.stride_tricks.sliding_window_view(blocks[0], (2 * radius + 1,) * 2), axis=(2, 3))]

    return neighbourhood(cells, kernel, {"v": "double"}, (radius, radius), size)


def edges(cells: DataFrame, size: tuple[int, int] = SIZE) -> DataFrame:
    """``v``: largest response of the four compass kernels, 0..255."""

    def kernel(blocks: list[np.ndarray], place: dict) -> list[np.ndarray]:
        w = np.lib.stride_tricks.sliding_window_view(blocks[0], (3, 3))
        return [np.minimum(np.max([np.abs((w * k).sum((2, 3))) for k in compass_kernels()], axis=0), 255)]

    return neighbourhood(cells, kernel, {"v": "long"}, (1, 1), size)


def gaussian(sigma: float) -> np.ndarray:
    """Weights from -3 to 3 sigmas, one place at least."""
    r = max(1, int(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return k / k.sum()


def blurred(cells: DataFrame, sigmas: tuple[float, ...], strip: int = STRIP, narrow: int = NARROW, whole: DataFrame | None = None) -> DataFrame:
    """``v`` and a blur of each sigma (b0, b1, ...): across and down, for all sigmas together.

    Planes of at most ``narrow`` cells across need one pass over tiles of whole rows, to which only ``v`` is sent; wider ones take two
    passes over strips, of which the second is sent all blurs.
    """
    weights = [gaussian(s) for s in sigmas]
    r = max(len(k) for k in weights) // 2
    names = tuple(f"b{i}" for i in range(len(sigmas)))
    form = {"v": "double"} | dict.fromkeys(names, "double")

    def along(axis: int, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        cut = slice(r - len(k) // 2, x.shape[axis] - r + len(k) // 2)
        return _shifted(x[:, cut] if axis else x[cut], len(k), axis, k)

    def both(b: list[np.ndarray], _: dict) -> list[np.ndarray]:
        wide = np.pad(b[0], ((0, 0), (r, r)), mode="edge")
        return [b[0][r:-r], *[along(0, along(1, wide, k), k) for k in weights]]

    across = lambda b, _: [b[0][:, r:-r], *[along(1, b[0], k) for k in weights]]
    down = lambda b, _: [b[0][r:-r], *[along(0, x, k) for x, k in zip(b[1:], weights)]]
    whole = staged(extents(cells), "plane-extents") if whole is None else whole
    widest = whole.agg(F.max("width")).first()[0] or 0
    if widest <= narrow:
        return neighbourhood(cells, both, form, (0, r), (max(1, widest), ROWS), whole=whole)
    first = neighbourhood(cells, across, form, (r, 0), (strip, 64), whole=whole)
    return neighbourhood(first, down, form, (0, r), (64, strip), ("v", *names), whole=whole)


def retinex(cells: DataFrame, sigmas: tuple[float, ...] = (15.0, 80.0, 250.0), strip: int = STRIP, narrow: int = NARROW) -> DataFrame:
    """``v``: log of the plane less the log of its blurs, averaged over scales, stretched to 0..255 over the plane."""
    parts = [F.log1p("v") - F.log(F.col(f"b{i}") + 1) for i in range(len(sigmas))]
    cells = staged(cells.select("plane", "x", "y", "v"), "plane-cells")  # read for its extents and for its blurs
    mean = staged(blurred(cells, sigmas, strip, narrow).select("plane", "x", "y", (sum(parts[1:], parts[0]) / len(parts)).alias("m")), "retinex")
    ends = staged(mean.groupBy("plane").agg(F.min("m").alias("lo"), (F.max("m") - F.min("m")).alias("spread")), "retinex-ends")  # one row a plane
    value = F.when(F.col("spread") > 0, F.floor((F.col("m") - F.col("lo")) / F.col("spread") * 255)).otherwise(0)
    return mean.join(ends, "plane").select("plane", "x", "y", value.cast("long").alias("v"))


def clahe(cells: DataFrame, clip: float = 2.0, grid: int = 8, size: tuple[int, int] = SIZE, bins: int = 256) -> DataFrame:
    """``v``: the plane equalised by a grid of ``grid`` x ``grid`` parts, between their centres by interpolation.

    A part's histogram is cut at ``clip`` times its mean, and what is cut off is spread over all levels. Histograms are an
    aggregate; a plane's tables, grid * grid * bins numbers, go to its tiles.
    """
    whole = extents(cells)
    part = lambda c: F.ceil(F.col(c) / grid)
    places = cells.join(whole, "plane").select(
        "plane", F.floor(F.col("y") / part("height")).alias("ty"), F.floor(F.col("x") / part("width")).alias("tx"), F.floor("v").cast("int").alias("level")
    )
    counts = places.groupBy("plane", "ty", "tx", "level").agg(F.count("*").alias("n"))
    listed = counts.groupBy("plane").agg(F.collect_list(F.struct("ty", "tx", "level", "n")).alias("counts"))  # grid * grid * bins at most

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for held in b.column("counts"):
                ty, tx, level, n = (held.values.field(c).to_numpy() for c in ("ty", "tx", "level", "n"))
                h = np.zeros((grid, grid, bins))
                h[ty, tx, level] = n
                area = np.maximum(h.sum(2, keepdims=True), 1)
                if clip > 0:
                    top = np.maximum(1, np.floor(clip * area / bins))
                    h = np.minimum(h, top) + np.maximum(h - top, 0).sum(2, keepdims=True) / bins
                out.append(np.clip(np.floor(np.cumsum(h, 2) * (bins - 1) / area + 0.5), 0, bins - 1).ravel())
            yield pa.RecordBatch.from_arrays([b.column("plane"), pa.array(out, pa.list_(pa.float64()))], ["plane", "context"])

    context = listed.mapInArrow(tables, "plane long, context array<double>")

    def kernel(blocks: list[np.ndarray], place: dict) -> list[np.ndarray]:
        table = np.array(place["context"]).reshape(grid, grid, bins)
        level = np.floor(blocks[0]).astype(int)

        def axis(start: int, n: int, total: int) -> tuple[list[np.ndarray], np.ndarray]:
            step = -(-total // grid)
            at = (start + np.arange(n) + 0.5) / step - 0.5
            low = np.floor(at).astype(int)
            return [np.clip(low + i, 0, -(-total // step) - 1) for i in (0, 1)], at - low

        ys, y = axis(place["y0"], level.shape[0], place["height"])
        xs, x = axis(place["x0"], level.shape[1], place["width"])
        take = lambda i, j: table[ys[i][:, None], xs[j][None], level]
        y, x = y[:, None], x[None]
        return [np.floor((take(0, 0) * (1 - x) + take(0, 1) * x) * (1 - y) + (take(1, 0) * (1 - x) + take(1, 1) * x) * y + 0.5)]

    return neighbourhood(cells, kernel, {"v": "long"}, (0, 0), size, whole=whole.join(context, "plane"))


def _grown(strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Weak places that hang together with strong ones inside a block."""
    while True:
        around = np.pad(strong, 1)
        h, w = strong.shape
        more = weak & np.any([around[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        if (more == strong).all():
            return strong
        strong = more


def canny(cells: DataFrame, low: float = 100.0, high: float = 200.0, size: tuple[int, int] = SIZE) -> DataFrame:
    """``v``: 255 on edges, else 0: Sobel gradients thinned along their direction, kept above ``high`` and, above ``low``, where they
    hang together with those.

    What hangs together is grown inside tiles, and again wherever a tile's neighbours have changed, until nothing does.
    """
    sobel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])

    def kernel(blocks: list[np.ndarray], place: dict) -> list[np.ndarray]:
        w = np.lib.stride_tricks.sliding_window_view(blocks[0], (3, 3))
        gx, gy = (w * sobel).sum((2, 3)), (w * sobel.T).sum((2, 3))
        h, n = gx.shape[0] - 2, gx.shape[1] - 2
        y, x = place["y0"] - 1 + np.arange(h + 2), place["x0"] - 1 + np.arange(n + 2)
        there = ((y >= 0) & (y < place["height"]))[:, None] & ((x >= 0) & (x < place["width"]))[None]
        strength = np.where(there, np.abs(gx) + np.abs(gy), 0)
        way = np.floor((np.degrees(np.arctan2(gy, gx)) % 180 + 22.5) / 45).astype(int)[1:-1, 1:-1] % 4  # along x, down right, along y, down left
        own = strength[1:-1, 1:-1]
        part = lambda i, j: strength[1 + i : 1 + i + h, 1 + j : 1 + j + n]
        top = np.choose(way, [(own > part(-i, -j)) & (own >= part(i, j)) for i, j in ((0, 1), (1, 1), (1, 0), (1, -1))])
        thin = np.where(top, own, 0)
        return [np.where(thin > high, 2, np.where(thin > low, 1, 0))]

    def grow(blocks: list[np.ndarray], place: dict) -> list[np.ndarray]:
        strong = _grown(blocks[0] == 2, blocks[0] > 0)
        return [np.where(strong, 2, blocks[0])[1:-1, 1:-1]]

    whole = staged(extents(cells), "plane-extents")
    kinds = staged(neighbourhood(cells, kernel, {"v": "long"}, (2, 2), size, whole=whole), "edge-kinds")
    some, before = kinds.where("v > 0"), -1
    while True:  # as often as an edge crosses tiles, at most
        n = some.where("v = 2").count()
        if n == before:
            break
        before = n
        some = staged(neighbourhood(some, grow, {"v": "long"}, (1, 1), size, outside=0.0, whole=whole), "edge-kinds")
    strong = some.where("v = 2").select("plane", "x", "y", F.lit(255).cast("long").alias("e"))
    return kinds.select("plane", "x", "y").join(strong, ["plane", "x", "y"], "left").select("plane", "x", "y", F.coalesce("e", F.lit(0).cast("long")).alias("v"))


def local_average(cells: DataFrame, feature: str = "v", value: str = "w", radius: int = 2, k: int = 9, scale: float = 0.01, size: tuple[int, int] = SIZE) -> DataFrame:
    """``v``: the mean of a value over the ``k`` cells of a square around each whose feature is most alike, weighted by the softmax of
    the negative squared difference times ``scale``; among equals the first by row counts. Cells beyond the plane don't count."""
    side = 2 * radius + 1

    def kernel(blocks: list[np.ndarray], place: dict) -> list[np.ndarray]:
        windows = [np.lib.stride_tricks.sliding_window_view(b, (side, side)) for b in blocks]
        f, c = (w.reshape(*w.shape[:2], -1) for w in windows)
        score = -scale * (f - f[:, :, side * side // 2, None]) ** 2
        score = np.where(np.isnan(score), -np.inf, score)
        best = np.argsort(-score, axis=2, kind="stable")[:, :, :k]
        weight = np.exp(np.take_along_axis(score, best, 2))  # the cell itself scores 0, the most there is
        return [(weight * np.nan_to_num(np.take_along_axis(c, best, 2))).sum(2) / weight.sum(2)]

    return neighbourhood(cells, kernel, {"v": "double"}, (radius, radius), size, (feature, value), np.nan)


def rotation(degrees: float) -> np.ndarray:
    """Turns by an angle; like all these matrices it takes places of the result to places of the source, both from -1 to 1."""
    a = np.radians(degrees)
    return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])


def zoom(scale: float, across: float = 0.5, down: float = 0.5) -> np.ndarray:
    """Shows 1 / ``scale`` of the plane, at shares of the room that is left."""
    room = 1 - 1 / scale
    return np.array([[1 / scale, 0, room * (2 * across - 1)], [0, 1 / scale, room * (2 * down - 1)], [0, 0, 1]])


def perspective(moved: list[tuple[float, float]]) -> np.ndarray:
    """Takes the corners (upper left, lower left, upper right, lower right) to the places ``moved``."""
    corners = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    rows, want = [], []
    for (x, y), (u, v) in zip(corners, moved):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        want += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(want, float)), 1).reshape(3, 3)


def resampled(
    cells: DataFrame, matrix: np.ndarray, width: int | None = None, height: int | None = None, outside: str = "zeros", side: int = 128
) -> DataFrame:
    """``v`` of planes seen through ``matrix``, ``width`` x ``height`` or as large as they were, between four cells by their distance.

    Each place of the result goes to the tile of ``side`` x ``side`` cells where its source lies, and each cell to the tiles that it touches;
    a task holds the cells of one tile while the places stream by. Beyond the plane there are ``zeros``, its ``border`` goes on, or it is mirrored (``reflection``).
    """
    whole = extents(cells)
    size = {c: F.col(c) if given is None else F.lit(given).cast("long") for c, given in (("width", width), ("height", height))}
    rows = whole.select("plane", "width", "height", size["width"].alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), size["height"] - 1)).alias("y"), size["height"].alias("h"))
    grid = rows.repartition("plane", "y").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("x"))
    u, v = ((F.col(c) * 2 + 1) / F.col(n) - 1 for c, n in (("x", "w"), ("y", "h")))
    a, b, c = (float(m[0]) * u + float(m[1]) * v + float(m[2]) for m in matrix)
    placed = grid.withColumns({"sx": (a / c + 1) / 2 * F.col("width") - 0.5, "sy": (b / c + 1) / 2 * F.col("height") - 0.5})

    def inside(x, n):
        last = F.col(n) - 1
        if outside == "border":
            return F.greatest(F.lit(0.0), F.least(x, last))
        turn = F.pmod(x + 0.5, F.col(n) * 2.0)  # mirrored at the outer sides of the cells
        return F.greatest(F.lit(0.0), F.least(F.least(turn, F.col(n) * 2.0 - turn) - 0.5, last))

    if outside not in ("zeros", "border", "reflection"):
        raise ValueError(f"{outside!r} is none of zeros, border, reflection")
    if outside != "zeros":
        placed = placed.withColumns({"sx": inside(F.col("sx"), "width"), "sy": inside(F.col("sy"), "height")})
    placed = placed.withColumns({"x0": F.floor("sx"), "y0": F.floor("sy")})
    # what is asked of a source tile meets its cells, and the row and column of cells behind them
    asked = placed.select("plane", F.floor(F.col("x0") / side).alias("tx"), F.floor(F.col("y0") / side).alias("ty"), "x", "y", "sx", "sy", F.lit(None).cast("double").alias("v"))
    near = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / side), F.floor((F.col(c) - 1) / side)))
    held = cells.select("plane", F.explode(near("x")).alias("tx"), "x", "y", "v").withColumn("ty", F.explode(near("y")))
    nothing = F.lit(None).cast("double")
    held = held.select("plane", "tx", "ty", "x", "y", nothing.alias("sx"), nothing.alias("sy"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    both = held.unionByName(asked).repartition("plane", "tx", "ty").sortWithinPartitions("plane", "tx", "ty", F.col("v").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = None, np.zeros((side + 1, side + 1))
        for batch in batches:
            plane, tx, ty, x, y, sx, sy, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            cell = batch.column(7).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(plane) != 0) | (np.diff(tx) != 0) | (np.diff(ty) != 0)) + 1
            for first, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if first == end:
                    continue
                if (tile := (plane[first], tx[first], ty[first])) != own:
                    own, block = tile, np.zeros((side + 1, side + 1))
                there = slice(first, first + int(cell[first:end].sum()))  # cells come first
                block[y[there] - tile[2] * side, x[there] - tile[1] * side] = v[there]
                want = slice(there.stop, end)
                if want.start == want.stop:
                    continue
                x0, y0 = np.floor(sx[want]), np.floor(sy[want])
                dx, dy = sx[want] - x0, sy[want] - y0
                i, j = (np.clip(np.nan_to_num(c - t * side), 0, side - 1).astype(int) for c, t in ((x0, tile[1]), (y0, tile[2])))
                upper = block[j, i] * (1 - dx) * (1 - dy) + block[j, i + 1] * dx * (1 - dy)
                made = upper + block[j + 1, i] * (1 - dx) * dy + block[j + 1, i + 1] * dx * dy
                arrays = [pa.array(np.asarray(c[want], np.int64)) for c in (plane, x, y)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(made)], ["plane", "x", "y", "v"])

    return both.mapInArrow(run, "plane long, x long, y long, v double")


def cut_out(cells: DataFrame, holes: list[tuple[float, float]], length: int) -> DataFrame:
    """Squares of ``length`` cells set to 0 around places given as shares of the plane's width and height."""
    placed = cells.join(extents(cells), "plane")
    near = lambda c, share, n: F.abs(F.col(c) - F.floor(share * F.col(n))) <= length // 2
    hole = F.lit(False)
    for across, down in holes:
        hole = hole | (near("x", across, "width") & near("y", down, "height"))
    return placed.select("plane", "x", "y", F.when(hole, 0).otherwise(F.col("v")).alias("v"))


def overlaid(base: DataFrame, top: DataFrame, across: int, down: int, opacity: float = 1.0, mode: str = "addition", mask: str | None = None) -> DataFrame:
    """``v`` of ``base`` with ``top`` laid over it, moved by ``across`` and ``down`` (they may be negative), in one of ``pixels.OVERLAYS``.

    The blend counts by ``opacity`` and, with a ``mask``, by this value of ``top`` over 255. Cells without any of ``top`` stay; what lies
    beyond ``base`` goes.
    """
    moved = top.select("plane", (F.col("x") + across).alias("x"), (F.col("y") + down).alias("y"), F.col("v").alias("_t"), (F.col(mask) if mask else F.lit(255)).alias("_m"))
    part = F.col("_m") / 255 * opacity
    mixed = F.col("v") * (1 - part) + overlay(F.col("v"), F.col("_t"), mode) * part
    met = base.select("plane", "x", "y", "v").join(moved, ["plane", "x", "y"], "left")
    return met.select("plane", "x", "y", F.when(F.col("_t").isNull(), F.col("v").cast("double")).otherwise(mixed).alias("v"))
