"""Operators over whole frames and planes: histograms, balance, stretches, neighbourhoods, tiles, structural similarity.

Statistics are plain aggregates; neighbours are equi-joins on coordinates; kernels that need a frame at once run over
arrays of one frame a row, Arrow batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, half_up
from tidemark.operators.ranking import group_ranks
from tidemark.session import dealt


def histogram(df: DataFrame, key: str, x: str, bins: int = 256) -> DataFrame:
    """Rows a bin of each key; ``x`` lies in [0, 1]."""
    place = F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return df.groupBy(key, place).agg(F.count("*").alias("n"))


def hellinger(h1: DataFrame, h2: DataFrame, key: str) -> DataFrame:
    """1 - Hellinger distance of two histograms a key."""
    sums = h1.groupBy(key).agg(F.sum("n").alias("s1")).join(h2.groupBy(key).agg(F.sum("n").alias("s2")), key)
    both = h1.join(h2.withColumnRenamed("n", "m"), [key, "bin"])
    both = both.groupBy(key).agg(F.sum(F.sqrt((F.col("n") * F.col("m")).cast("double"))).alias("o"))
    share = F.coalesce("o", F.lit(0.0)) / F.sqrt((F.col("s1") * F.col("s2")).cast("double"))
    near = half_up(1 - F.sqrt(F.greatest(F.lit(0.0), 1 - share))).alias("similarity")
    return sums.join(both, key, "left").select(key, near)


def cut_bins(hist: DataFrame, key: str, percent: float) -> DataFrame:
    """First bin with half the percentage below it, and first with as much above."""
    w = Window.partitionBy(key).orderBy("bin")
    total = F.sum("n").over(Window.partitionBy(key))
    cut = percent / 200
    cdf = hist.withColumn("cdf", F.sum("n").over(w)).withColumn("t", total)
    return cdf.groupBy(key).agg(
        F.min(F.when(F.col("cdf") >= F.col("t") * cut, F.col("bin"))).alias("low"),
        F.min(F.when(F.col("cdf") >= F.col("t") - F.col("t") * cut, F.col("bin"))).alias("high"),
    )


def equalised(hist: DataFrame, key: str) -> DataFrame:
    """The value each bin maps to so that the histogram becomes flat."""
    w = Window.partitionBy(key).orderBy("bin")
    total, first = F.sum("n").over(Window.partitionBy(key)), F.first("n").over(w)
    cdf = hist.withColumns({"cdf": F.sum("n").over(w), "t": total, "n0": first})
    flat = F.floor((F.col("cdf") - F.col("n0")) * 255 / F.nullif(F.col("t") - F.col("n0"), F.lit(0)).cast("double") + 0.5)
    value = F.when(F.col("t") == F.col("n0"), F.col("bin")).otherwise(flat).cast("long")
    return cdf.select(key, "bin", value.alias("value"))


def stretched(df: DataFrame, key: str, x: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Stretch between two percentiles, and min-max normalised inside a luma gate."""
    marks = df.groupBy(key).agg(
        F.percentile(x, F.lit(low)).alias("lo"), F.percentile(x, F.lit(high)).alias("hi"), F.min(x).alias("mn"), F.max(x).alias("mx")
    )
    v = F.col(x)
    wide = F.when(F.col("hi") > F.col("lo"), clamp((v - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0)).otherwise(v)
    inside = (v > 0.1) & (v < 0.9) & (F.col("mx") > F.col("mn"))
    normed = F.when(inside, (v - F.col("mn")) / (F.col("mx") - F.col("mn")) * 255).otherwise(v * 255)
    return df.join(marks, key).select(key, "n", half_up(wide).alias("stretched"), half_up(normed).alias("normed"))


def white_balance(df: DataFrame, key: str) -> DataFrame:
    """Gains that bring each key's channel means to the brightest, normalised."""
    means = df.groupBy(key).agg(*[F.avg(c).alias(f"a{c}") for c in "rgb"], F.count("*").alias("n"))
    top = F.greatest("ar", "ag", "ab")
    gains = {c: top / F.col(f"a{c}") for c in "rgb"}
    norm = F.greatest(F.sqrt(sum(g * g for g in gains.values()) / 3), F.lit(1e-9))
    return means.select(key, "n", *[half_up(g / norm).alias(f"gain_{c}") for c, g in gains.items()])


def psnr(df: DataFrame, folder: str, file: str, a: str, b: str) -> DataFrame:
    """Signal to noise of each file, its mean a folder, and the mean normalised distance."""
    d = (F.col(a) - F.col(b)).cast("double")
    files = df.groupBy(folder, file).agg(F.avg(d * d).alias("mse"), (F.avg(F.abs(d)) / 255).alias("dist"))
    db = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(255.0) / F.sqrt("mse")) * 20)
    return files.groupBy(folder).agg(
        half_up(F.avg(db)).alias("psnr"), half_up(F.avg("dist")).alias("distance"), F.count("*").alias("n")
    )


def laplacian(plane: DataFrame, by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """``laplacian`` of v at (x, y), of each plane ``by``; a missing neighbour counts as the place itself.

    Every place sends its value to its neighbours, and one aggregation gathers them: one shuffle in place of four joins. With the number
    of ``rows`` it goes to as many parts as they ask for.
    """
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    sent = plane.select("*", F.explode(near).alias("d"))
    sent = sent.select(
        *by, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), "v",
        ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"),
    )
    sent = sent if rows is None else dealt(sent, 5 * rows, *by, "x", "y")
    got = sent.groupBy(*by, "x", "y").agg(
        F.max(F.when(F.col("own"), F.col("v"))).alias("v"),
        F.sum(F.when(~F.col("own"), F.col("v"))).alias("around"),
        F.count_if(~F.col("own")).alias("k"),
    )
    lap = F.coalesce("around", F.lit(0)) + F.col("v") * (4 - F.col("k")) - F.col("v") * 4
    return got.where("v is not null").withColumn("laplacian", lap)


def split_tiles(plane: DataFrame, width: int, overlap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``plane`` in two tiles that overlap on both sides of its middle, with ramp weights."""
    half, ramp = width // 2, 2 * overlap
    left = F.when(F.col("x") < half + overlap, F.least(F.lit(1.0), (half + overlap - F.col("x")) / ramp))
    right = F.when(F.col("x") >= half - overlap, F.least(F.lit(1.0), (F.col("x") - (half - overlap - 1)) / ramp))
    tiles = F.array(F.struct(F.lit(0).alias("tile"), left.alias("w")), F.struct(F.lit(1).alias("tile"), right.alias("w")))
    return plane.select("*", F.explode(F.filter(tiles, lambda t: t.w.isNotNull())).alias("t")).select(*by, "x", "y", "v", "t.*")


def join_tiles(tiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Tiles put together by their weights."""
    value = half_up(F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v")
    return tiles.groupBy(*by, "x", "y").agg(value, F.count("*").alias("tiles"))


def frames(df: DataFrame, side: int = 8) -> DataFrame:
    """frame_id, a and b: square frames of two channels, a row each, from the samples of each line in key order.

    Samples are numbered by ranges, so a line is many tasks. A line's last frame is filled up with its last sample.
    """
    cells = group_ranks(df.select("line", "row_id", "p", "s", "g", "r", "r2"), ["line"], [F.col(c) for c in ("row_id", "p", "s", "g", "r", "r2")])
    cells = cells.withColumn("_at", F.col("rank") - 1).withColumn("_f", F.floor(F.col("_at") / (side * side)))
    grouped = cells.groupBy("line", "_f").agg(
        F.sort_array(F.collect_list(F.struct("_at", "r", "r2"))).alias("c")  # side * side cells at most
    )
    whole = F.concat("c", F.array_repeat(F.element_at("c", -1), side * side - F.size("c"))).alias("c")
    frame_id = (F.col("line").cast("long") * 1_000_000_000 + F.col("_f")).cast("long").alias("frame_id")
    return grouped.select(frame_id, whole).select("frame_id", F.col("c.r").alias("a"), F.col("c.r2").alias("b"))


def _per_frame(df: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str, kind: str, side: int = 8) -> DataFrame:
    """frame_id and what ``f`` makes of the stacked frames (n, side, side) of a batch: a number or a list a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).flatten().to_numpy().astype(float).reshape(-1, side, side) for c in ("a", "b"))
            out = f(a, b)
            if out.ndim == 1:
                made = pa.array(out)
            else:
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * side * side)
                made = pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("frame_id"), made], ["frame_id", name])

    return df.mapInArrow(run, f"frame_id long, {name} {kind}")


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, (k, k), (1, 2))


def ssim(a: np.ndarray, b: np.ndarray, k: int = 7) -> np.ndarray:
    """Mean structural similarity over uniform windows of each pair of stacked frames."""
    wa, wb, n = _windows(a, k), _windows(b, k), k * k
    ma, mb = wa.mean((3, 4)), wb.mean((3, 4))
    va, vb = wa.var((3, 4)) * n / (n - 1), wb.var((3, 4)) * n / (n - 1)
    cov = ((wa * wb).mean((3, 4)) - ma * mb) * n / (n - 1)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean((1, 2))


def ssim_series(df: DataFrame) -> DataFrame:
    """ssim of each frame's two channels."""
    return _per_frame(df, lambda a, b: np.round(ssim(a, b), 4), "ssim", "double")


def _blur(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (1, 2):
        pad = np.pad(x, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
        x = np.lib.stride_tricks.sliding_window_view(pad, 2 * r + 1, axis) @ k
    return x


def retinex(df: DataFrame, sigmas: tuple[float, ...] = (1.0, 2.0, 4.0)) -> DataFrame:
    """``v``: log of the frame less the log of its blurs, averaged over scales, stretched to 0..255."""

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = np.mean([np.log1p(a) - np.log(_blur(a, s) + 1) for s in sigmas], axis=0)
        low = m.min((1, 2), keepdims=True)
        spread = m.max((1, 2), keepdims=True) - low
        return np.floor(np.where(spread > 0, (m - low) / np.where(spread > 0, spread, 1) * 255, 0)).astype(np.int64)

    return _per_frame(df, f, "v", "array<long>")


def _tile_tables(a: np.ndarray, tiles: int, clip: float, bins: int) -> np.ndarray:
    """(n, tiles, tiles, bins): the value each level maps to in each tile."""
    n, side = len(a), a.shape[1]
    w = side // tiles
    cells = a.astype(int).reshape(n, tiles, w, tiles, w).transpose(0, 1, 3, 2, 4).reshape(n * tiles * tiles, w * w)
    h = np.bincount((np.arange(len(cells))[:, None] * bins + cells).ravel(), minlength=len(cells) * bins).reshape(-1, bins).astype(float)
    if clip > 0:
        top = max(1, int(clip * w * w / bins))
        h = np.minimum(h, top) + np.maximum(h - top, 0).sum(1, keepdims=True) / bins
    table = np.clip(np.floor(np.cumsum(h, 1) * (bins - 1) / (w * w) + 0.5), 0, bins - 1)
    return table.reshape(n, tiles, tiles, bins)


def _tiled(a: np.ndarray, clip: float = 2.0, tiles: int = 2, bins: int = 256) -> np.ndarray:
    """Stacked frames equalised by their tiles' tables."""
    side = a.shape[1]
    tables, levels = _tile_tables(a, tiles, clip, bins), a.astype(int)
    at = (np.arange(side) + 0.5) / (side // tiles) - 0.5
    low = np.floor(at).astype(int)
    part = at - low
    k = [np.clip(low + i, 0, tiles - 1) for i in (0, 1)]
    take = lambda i, j: tables[np.arange(len(a))[:, None, None], k[i][None, :, None], k[j][None, None, :], levels]
    y, x = part[None, :, None], part[None, None, :]
    v = (take(0, 0) * (1 - x) + take(0, 1) * x) * (1 - y) + (take(1, 0) * (1 - x) + take(1, 1) * x) * y
    return np.floor(v + 0.5).astype(np.int64)


def clahe(df: DataFrame, clip: float = 2.0, tiles: int = 2, bins: int = 256) -> DataFrame:
    """``v``: the frame equalised tile by tile, between the tiles' centres by interpolation.

    A tile's histogram is cut at ``clip`` times its mean, and what is cut off is spread over all levels.
    """

    return _per_frame(df, lambda a, b: _tiled(a, clip, tiles, bins), "v", "array<long>")


def compass_kernels() -> list[np.ndarray]:
    """Four kernels that answer to edges in four directions, two steps of the ring apart."""
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]

    def kernel(turn: int) -> np.ndarray:
        k = np.zeros((3, 3))
        for i, at in enumerate(ring):
            k[at] = 5 if (i - turn) % 8 < 3 else -3
        return k

    return [kernel(t) for t in (0, 2, 4, 6)]


def edges(df: DataFrame) -> DataFrame:
    """``v``: largest response of the four compass kernels, 0..255."""
    kernels = compass_kernels()

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        w = _windows(np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge"), 3)
        v = np.max([np.abs((w * k).sum((3, 4))) for k in kernels], axis=0)
        return np.minimum(v, 255).astype(np.int64)

    return _per_frame(df, f, "v", "array<long>")


def canny(df: DataFrame, low: float = 100.0, high: float = 200.0) -> DataFrame:
    """``v``: 255 on edges, else 0: Sobel gradients thinned along their direction, kept above ``high`` and, above ``low``, where
    they hang together with those."""

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        w = _windows(np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge"), 3)
        kernel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
        gx, gy = (w * kernel).sum((3, 4)), (w * kernel.T).sum((3, 4))
        size = np.abs(gx) + np.abs(gy)
        angle = np.degrees(np.arctan2(gy, gx)) % 180
        way = np.floor((angle + 22.5) / 45).astype(int) % 4  # along x, down right, along y, down left
        p = np.pad(size, ((0, 0), (1, 1), (1, 1)))
        side = a.shape[1]
        part = lambda dy, dx: p[:, 1 + dy : 1 + dy + side, 1 + dx : 1 + dx + side]
        steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
        top = np.choose(way, [(size > part(-y, -x)) & (size >= part(y, x)) for y, x in steps])
        thin = np.where(top, size, 0)
        kept, weak = thin > high, thin > low
        while True:
            around = np.pad(kept, ((0, 0), (1, 1), (1, 1)))
            grown = weak & np.any([around[:, 1 + y : 1 + y + side, 1 + x : 1 + x + side] for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)
            if (grown == kept).all():
                return np.where(kept, 255, 0).astype(np.int64)
            kept = grown

    return _per_frame(df, f, "v", "array<long>")


def _flat(a: np.ndarray) -> np.ndarray:
    """Stacked frames, each with a flat histogram."""
    n, bins = len(a), 256
    levels = a.astype(int).reshape(n, -1)
    h = np.bincount((np.arange(n)[:, None] * bins + levels).ravel(), minlength=n * bins).reshape(n, bins)
    cdf = np.cumsum(h, 1)
    first = h[np.arange(n), levels.min(1)][:, None]
    rest = levels.shape[1] - first
    table = np.where(rest > 0, np.floor((cdf - first) * 255 / np.maximum(rest, 1) + 0.5), np.arange(bins)[None])
    return np.take_along_axis(table, levels, 1).reshape(a.shape)


def equalised_frames(df: DataFrame, method: str, weight: float = 0.5, gate: tuple[float, float] = (0.15, 0.70)) -> DataFrame:
    """``v``: frames equalised by a method: ``tiles``, ``flat``, ``mix`` (flat by ``weight``, else tiles) or ``table`` (spread to the
    full range, then gamma 1.2). Frames whose mean luma lies outside the gate stay."""

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if method == "table":
            low, high = a.min((1, 2), keepdims=True), a.max((1, 2), keepdims=True)
            wide = np.where(high > low, (a - low) * 255 / np.where(high > low, high - low, 1), a)
            v = (np.floor(wide) / 255) ** (1 / 1.2) * 255
        else:
            tiled = _tiled(a) if method != "flat" else 0
            v = tiled if method == "tiles" else _flat(a) if method == "flat" else tiled * (1 - weight) + _flat(a) * weight
        mean = a.mean((1, 2), keepdims=True) / 255
        return np.floor(np.where((mean >= gate[0]) & (mean <= gate[1]), v, a)).astype(np.int64)

    if method not in ("tiles", "flat", "mix", "table"):
        raise ValueError(f"{method!r} is none of tiles, flat, mix, table")
    return _per_frame(df, f, "v", "array<long>")


def channel_statistics(df: DataFrame, key: str) -> DataFrame:
    """Mean and sample deviation of each channel, and how colourful a frame is."""
    rg, yb = F.col("r") - F.col("g"), (F.col("r") + F.col("g")) / 2 - F.col("b")
    stats = [half_up(f(c)).alias(f"{n}_{c}") for c in "rgb" for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    spread = F.sqrt(F.var_pop(rg) + F.var_pop(yb))
    centre = F.sqrt(F.pow(F.avg(rg), F.lit(2.0)) + F.pow(F.avg(yb), F.lit(2.0)))
    return df.groupBy(key).agg(*stats, half_up(spread + centre * 0.3).alias("colourfulness"))


def downsampled(plane: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of k x k cells."""
    cell = [F.floor(F.col(c) / k).cast("long").alias(c) for c in ("x", "y")]
    return plane.groupBy(*by, *cell).agg(half_up(F.avg("v")).alias("v"), F.count("*").alias("n"))


def flipped(plane: DataFrame, width: int) -> DataFrame:
    """Mirrored left to right."""
    return plane.withColumn("x", F.lit(width - 1) - F.col("x"))


def cropped(plane: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """A window of the plane, moved to the origin."""
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return plane.where(inside).withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def plane_stats(df: DataFrame, key: str, planes: tuple[tuple[str, str], ...]) -> DataFrame:
    """Mean of each plane, and its mean absolute difference from the aligned one, floored at 0.0001."""
    out = []
    for a, b in planes:
        out.append(half_up(F.avg(F.col(a)) / 255, 5).alias(f"mean_{a}"))
        out.append(F.greatest(half_up(F.avg(F.abs(F.col(a) - F.col(b))) / 255, 5), F.lit(0.0001)).alias(f"diff_{a}"))
    return df.groupBy(key).agg(*out)


def pixel_distance(df: DataFrame, keys: list[str], a: str, b: str, align: bool = True) -> DataFrame:
    """Mean distance of two planes as a share of their range; with ``align`` the darker one is raised to the other's whole mean first."""
    means = df.groupBy(*keys).agg(F.floor(F.avg(a)).alias("_a"), F.floor(F.avg(b)).alias("_b"))
    rows = df.join(means, keys)
    up = lambda x, own, other: clamp(F.col(x) + F.greatest(other - own, F.lit(0)), 0, 255)
    left, right = (up(a, F.col("_a"), F.col("_b")), up(b, F.col("_b"), F.col("_a"))) if align else (F.col(a), F.col(b))
    return rows.groupBy(*keys).agg(half_up(F.avg(F.abs(left - right)) / 255).alias("distance"))


def split_grid(plane: DataFrame, width: int, height: int, overlap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``plane`` in two by two tiles that overlap around its middle, with ramp weights both ways; ``join_tiles`` puts them together."""

    def halves(c: str, size: int) -> list[Column]:
        half, ramp = size // 2, 2 * overlap
        first = F.when(F.col(c) < half + overlap, F.least(F.lit(1.0), (half + overlap - F.col(c)) / ramp))
        return [first, F.when(F.col(c) >= half - overlap, F.least(F.lit(1.0), (F.col(c) - (half - overlap - 1)) / ramp))]

    across, down = halves("x", width), halves("y", height)
    tiles = F.array(*[F.struct(F.lit(2 * j + i).alias("tile"), (across[i] * down[j]).alias("w")) for j in (0, 1) for i in (0, 1)])
    return plane.select("*", F.explode(F.filter(tiles, lambda t: t.w.isNotNull())).alias("t")).select(*by, "x", "y", "v", "t.*")


def matched(df: DataFrame, key: str, x: str, like: str) -> DataFrame:
    """``df`` with ``matched``: a channel moved to the mean and deviation of another, key by key."""
    stats = df.groupBy(key).agg(*[f(c).alias(n) for c, k in ((x, "x"), (like, "l")) for f, n in ((F.avg, f"_m{k}"), (F.stddev_samp, f"_s{k}"))])
    unit = (F.col(x) - F.col("_mx")) / F.nullif(F.col("_sx"), F.lit(0.0))
    return df.join(stats, key).withColumn("matched", F.coalesce(unit, F.lit(0.0)) * F.col("_sl") + F.col("_ml")).drop("_mx", "_sx", "_ml", "_sl")


def rotated(plane: DataFrame, height: int) -> DataFrame:
    """A quarter turn clockwise."""
    return plane.withColumns({"x": F.lit(height - 1) - F.col("y"), "y": F.col("x")})
