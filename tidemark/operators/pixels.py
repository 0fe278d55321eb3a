"""Element-wise algebra of 8-bit samples as column expressions: luma, ranges, blends, chroma, overlays, hue rules.

Every function takes and gives columns, so a chain of them stays one projection in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, to_byte

RGB = tuple[Column, Column, Column]


def rgb(*names: str) -> RGB:
    """Three columns by name."""
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def luma(c: RGB) -> Column:
    """Brightness by the BT.601 weights."""
    return clamp(c[0] * 0.299 + c[1] * 0.587 + c[2] * 0.114, 0.0, 255.0)


def luma_mask(y: Column, threshold: float) -> Column:
    """255 above the threshold share, else 0."""
    return F.when(y > round(threshold * 255), 255).otherwise(0).cast("long")


def luma_weight(y: Column, dark: float, white: float) -> Column:
    """Weight that rises from a dark limit to a white one (shares of 255); plain luma share for no dark limit."""
    if dark == 0:
        return y / 255
    w = round(white * 255)
    t = min(round(255 * dark), w - 10)
    return clamp((y - t) * round(1 / (w - t), 3), 0.0, 1.0)


def weighted(a: RGB, b: RGB, w: Column | float) -> RGB:
    """a * (1 - w) + b * w; a weight of 0 or 1 gives one side as it is."""
    if not isinstance(w, Column):
        if w in (0, 1):
            return b if w else a
        w = F.lit(float(w))
    return tuple(to_byte(x * (1 - w) + y * w) for x, y in zip(a, b))  # type: ignore[return-value]


def masked(a: RGB, b: RGB, mask: Column) -> RGB:
    """Blend by an 8-bit mask: b where it is 255."""
    return weighted(a, b, mask / 255)


def by_luma(a: RGB, b: RGB, threshold: float) -> RGB:
    """b where b is brighter than the threshold, else a."""
    return masked(a, b, luma_mask(luma(b), threshold))


def by_luma_gradient(a: RGB, b: RGB, dark: float, white: float) -> RGB:
    """a fading into b as b gets brighter."""
    return weighted(a, b, luma_weight(luma(b), dark, white))


def adaptive(a: RGB, b: RGB, w: float, limit: float, decay: float, least: float) -> RGB:
    """Blend whose weight falls with b's luma below a limit, to ``least`` at most."""
    share = luma(b) / 255
    dim = F.greatest(F.pow(share / limit, F.lit(decay)) * w, F.lit(least))
    return weighted(a, b, F.when(share < limit, dim).otherwise(F.lit(float(w))))


def to_yuv(c: RGB) -> RGB:
    """Luma and the two colour differences around 128."""
    y = c[0] * 0.299 + c[1] * 0.587 + c[2] * 0.114
    u = (c[2] - y) * 0.564 + 128
    return y, u, (c[0] - y) * 0.713 + 128


def to_rgb(c: RGB) -> RGB:
    """The inverse, as 8-bit samples."""
    y, u, v = c[0], c[1] - 128, c[2] - 128
    return to_byte(y + v * 1.403), to_byte(y - u * 0.344 - v * 0.714), to_byte(y + u * 1.773)


def constrained_chroma(stable: RGB, new: RGB, alpha: float) -> RGB:
    """Stable luma with the new colour differences, kept within a share around the stable ones."""
    s, n = to_yuv(stable), to_yuv(new)
    near = [clamp(x, y * (1 - alpha), y * (1 + alpha)) for x, y in zip(n[1:], s[1:])]
    return to_rgb((s[0], *near))


def luma_from(a: RGB, colour: RGB) -> RGB:
    """a's luma with the other's colour differences."""
    return to_rgb((to_yuv(a)[0], *to_yuv(colour)[1:]))


def tweak(c: RGB, hue: float = 0, sat: float = 1, bright: float = 0, cont: float = 1) -> RGB:
    """Turn and scale the colour differences, scale and shift the luma."""
    y, u, v = to_yuv(c)
    s, k = math.sin(math.radians(hue)) * sat, math.cos(math.radians(hue)) * sat
    lum = F.floor(clamp((y - 16) * cont + bright + 16.5, 0.0, 255.0))
    return to_rgb((lum, (u - 128) * k + (v - 128) * s + 128, (v - 128) * k - (u - 128) * s + 128))


def levels(x: Column, low_in: float, high_in: float, low_out: float, high_out: float, gamma: float = 1.0) -> Column:
    """Map a range to another, with gamma."""
    share = clamp((x - low_in) / (high_in - low_in), 0.0, 1.0)
    return to_byte(F.pow(share, F.lit(1 / gamma)) * (high_out - low_out) + low_out)


def dark_gamma(y: Column, gamma: float, limit: float, alpha: float, least: float) -> Column:
    """Gamma that weakens with the luma share below a limit."""
    share = y / 255
    g = F.when(share < limit, F.greatest(F.pow(share / limit, F.lit(alpha)) * gamma, F.lit(least))).otherwise(gamma)
    return to_byte(F.pow(share, 1 / g) * 255)


def luma_floor(y: Column, mean: Column, least: float) -> Column:
    """Raise a dark frame's luma by what its mean lacks."""
    return to_byte(y + F.floor(F.greatest(F.lit(least) - mean, F.lit(0.0)) * 255))


def hue(c: RGB) -> Column:
    """Hue in [0, 180): half degrees."""
    r, g, b = c
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    six = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d == 0, F.lit(0.0)).otherwise(((six + 6) % 6) * 30)


def saturation(c: RGB) -> Column:
    """Saturation in [0, 255]."""
    top, low = F.greatest(*c), F.least(*c)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - low) * 255.0 / top)


def hue_add(h: Column, shift: float) -> Column:
    """Hue turned by degrees, wrapped at 180."""
    return F.pmod(h + shift / 2, F.lit(180.0))


#: Named hue ranges in degrees.
HUES = {
    "red": (0, 30),
    "orange": (30, 60),
    "yellow": (60, 90),
    "yellow-green": (90, 120),
    "green": (120, 150),
    "blue-green": (150, 180),
    "cyan": (180, 210),
    "blue": (210, 240),
    "blue-violet": (240, 270),
    "violet": (270, 300),
    "red-violet": (300, 330),
    "rose": (330, 360),
}


def parse_hues(rule: str) -> list[tuple[float, float]]:
    """Ranges of ``"a:b,c:d"`` or of colour names, in degrees."""
    ranges = []
    for part in rule.split(","):
        part = part.strip().lower()
        low, high = HUES[part] if part in HUES else map(float, part.split(":"))
        if not 0 <= low < high <= 360:
            raise ValueError(f"{part!r} is no hue range")
        ranges.append((float(low), float(high)))
    return ranges


def in_hues(h: Column, rule: str) -> Column:
    """Whether a half-degree hue lies strictly in one of the ranges."""
    found = F.lit(False)
    for low, high in parse_hues(rule):
        found = found | ((h > low / 2) & (h < high / 2))
    return found


def hue_adjusted(c: RGB, rule: str) -> RGB:
    """``"range[,range]|saturation,weight"`` or ``"range|+hue,weight"``: pixels in the ranges blend into a tweaked copy."""
    ranges, _, change = rule.partition("|")
    value, _, weight = change.partition(",")
    number = float(value)
    turned = value.strip()[0] in "+-" or number > 10
    changed = tweak(c, hue=number) if turned else tweak(c, sat=number)
    mixed = weighted(c, changed, float(weight or 1))
    inside = in_hues(hue(c), ranges)
    return tuple(F.when(inside, m).otherwise(x) for m, x in zip(mixed, c))  # type: ignore[return-value]


def gray_filled(gray: RGB, colour: RGB, limit: float, sat: float = 1.0) -> RGB:
    """Pixels whose saturation is below the limit filled from another image."""
    fill = tweak(colour, sat=sat) if sat != 1 else colour
    pale = saturation(gray) < limit
    return tuple(F.when(pale, y).otherwise(x) for x, y in zip(gray, fill))  # type: ignore[return-value]


def gray_faded(gray: RGB, colour: RGB, limit: float, alpha: float) -> RGB:
    """The same with a weight that falls as a power of the saturation."""
    w = F.pow(clamp(1 - saturation(gray) / limit, 0.0, 1.0), F.lit(float(alpha)))
    return weighted(gray, colour, w)


#: The blend modes by name; ``overlay`` has the textbook formula of each.
OVERLAYS = ("normal", "addition", "average", "difference", "divide", "exclusion", "multiply", "overlay", "subtract")


def overlay(a: Column, b: Column, mode: str, peak: int = 255) -> Column:
    """Blend of a base and an overlay sample."""
    half = peak / 2
    found = {
        "normal": lambda: b,
        "addition": lambda: a + b,
        "average": lambda: (a + b) / 2,
        "difference": lambda: F.abs(a - b),
        "divide": lambda: F.when(b == 0, F.lit(float(peak))).otherwise(a * float(peak) / F.nullif(b, F.lit(0))),
        "exclusion": lambda: a + b - 2.0 * a * b / peak,
        "multiply": lambda: a * b / float(peak),
        "overlay": lambda: F.when(a < half, 2.0 * a * b / peak).otherwise(peak - 2.0 * (peak - a) * (peak - b) / peak),
        "subtract": lambda: a - b,
    }
    if mode not in found:
        raise ValueError(f"{mode!r} is none of {', '.join(OVERLAYS)}")
    return to_byte(found[mode]())


def channel_gain(x: Column, gain: float, bias: float, gamma: float) -> Column:
    """Gain and bias, then gamma."""
    if not (0.1 <= gain <= 10 and 0.1 <= gamma <= 10):
        raise ValueError("gain and gamma must lie in [0.1, 10]")
    return levels(to_byte(x * gain + bias), 0, 255, 0, 255, gamma)


#: sRGB to XYZ (D65) and the white point.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)


def to_lab(c: RGB) -> RGB:
    """CIELAB of 8-bit sRGB."""
    lin = [F.when(x / 255 > 0.04045, F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 255 / 12.92) for x in c]
    xyz = [(lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2]) / w for m, w in zip(_XYZ, _WHITE)]
    f = [F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116) for t in xyz]
    return f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200


def dark_red_fix(c: RGB) -> RGB:
    """Saturation lowered in dark bands."""
    y = luma(c) / 255
    out = list(c)
    for limit, sat in ((0.3, 0.9), (0.2, 0.8), (0.1, 0.7)):
        less = tweak(c, sat=sat)
        out = [F.when(y < limit, n).otherwise(x) for n, x in zip(less, out)]
    return tuple(out)  # type: ignore[return-value]


def merge(a: RGB | None, b: RGB | None, method: int, weight: float = 0.5, **options) -> RGB:
    """Two colourings merged: 2 simple, 3 constrained chroma, 4 by luma, 5 adaptive luma, 6 chroma retention, 7 chroma bound,
    whose tolerance follows the ``laplacian`` of the stable luma.

    With one side missing, or method 0 or 1, one side is the result.
    """
    if a is None or b is None:
        return b if a is None else a
    if method in (0, 1):
        return b if method else a
    if method == 2:
        return weighted(a, b, weight)
    if method == 3:
        near = dark_red_fix(constrained_chroma(a, b, options.get("alpha", 0.2)))
        return weighted(weighted(a, near, min(weight, 0.6)), b, 0.3)
    if method == 4:
        return weighted(a, by_luma(a, b, options.get("threshold", 0.4)), weight)
    if method == 5:
        return adaptive(a, b, weight, options.get("limit", 0.6), options.get("decay", 1.0), options.get("least", 0.15))
    if method == 6:
        kept = gray_faded(a, b, options.get("limit", 60), max(1.0, min(10.0, options.get("alpha", 2.0))))
        return weighted(a, luma_from(a, kept), weight)
    if method == 7:
        near = tolerant_chroma(a, b, chroma_tolerance(options.get("laplacian", F.lit(0)), options.get("base", 14), options.get("extra", 18)))
        return dark_red_fix(weighted(a, near, weight))
    raise ValueError("methods are 0 to 7")


def chroma_tolerance(laplacian: Column, base: float = 14, extra: float = 18) -> Column:
    """How far colour differences may move: more where the luma has texture."""
    return F.least(F.abs(laplacian) / 255.0, F.lit(1.0)) * extra + base


def tolerant_chroma(stable: RGB, new: RGB, tolerance: Column) -> RGB:
    """Stable luma with the new colour differences, kept within a tolerance of the stable ones, as whole numbers."""
    s, n = to_yuv(stable), to_yuv(new)
    kept = [F.floor(clamp(x, clamp(y - tolerance, 0.0, 255.0), clamp(y + tolerance, 0.0, 255.0))) for x, y in zip(n[1:], s[1:])]
    return to_rgb((s[0], *kept))


def gray_share(df: DataFrame, key: str, limit: float, most: float) -> DataFrame:
    """key, the share of pixels with a saturation below ``limit``, and whether it is above ``most``."""
    share = F.avg((saturation(rgb("r", "g", "b")) < limit).cast("double"))
    return df.groupBy(key).agg(share.alias("share")).withColumn("gray", F.col("share") > most)


#: The range of luma in limited-range video.
LIMITED = (16, 235)


def to_full_range(x: Column) -> Column:
    """A limited-range sample as a full-range one."""
    return F.floor(clamp((x - LIMITED[0]) * 255.0 / (LIMITED[1] - LIMITED[0]) + 0.5, 0.0, 255.0)).cast("long")


def to_limited_range(x: Column) -> Column:
    """A full-range sample as a limited-range one."""
    return F.floor(x * (LIMITED[1] - LIMITED[0]) / 255.0 + LIMITED[0] + 0.5).cast("long")


def smoothed_to(before: RGB, c: RGB, share: float = 0.2) -> RGB:
    """Each sample within a share around the one before; where there is none it stays."""
    return tuple(F.coalesce(to_byte(clamp(x, y * (1 - share), F.least(y * (1 + share), F.lit(255.0)))), x) for x, y in zip(c, before))  # type: ignore[return-value]


def from_hsv(h: Column, s: Column, v: Column) -> RGB:
    """8-bit samples of hue and saturation in [0, 1) and [0, 1], and a value in [0, 255]."""
    six = h * 6
    part = six - F.floor(six)
    low, down, up = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    at = F.floor(six) % 6
    pick = lambda *order: to_byte(F.element_at(F.array(*order), (at + 1).cast("int")) + 0.5)
    return pick(v, down, low, low, up, v), pick(up, v, v, down, low, low), pick(low, low, up, v, v, down)


def hue_turned(c: RGB, degrees: float) -> RGB:
    """Hue turned in steps of 1/256 of a circle, 255 of which are the degrees of one."""
    h = (F.floor(hue(c) / 180 * 255) + int(degrees / 360.0 * 255)) % 256
    return from_hsv(F.pmod(h, F.lit(256)) / 256, saturation(c) / 255, F.greatest(*c))


def enhanced(c: RGB, gamma: float = 1, hue: float = 0, bright: float = 0, cont: float = 1, sat: float = 1, mean: Column | None = None) -> RGB:
    """Gamma, hue, brightness, contrast around a mean luma, saturation around the own luma: in this order, what is neutral left out."""
    if gamma != 1:
        c = tuple(to_byte(F.pow(x / 255, F.lit(1 / gamma)) * 255) for x in c)  # type: ignore[assignment]
    if hue:
        c = hue_turned(c, hue)
    if bright:
        c = tuple(to_byte(x * (1 + bright / 255)) for x in c)  # type: ignore[assignment]
    if cont != 1:
        m = F.lit(128.0) if mean is None else mean
        c = tuple(to_byte(m * (1 - cont) + x * cont) for x in c)  # type: ignore[assignment]
    if sat != 1:
        gray = F.floor(luma(c))
        c = tuple(to_byte(gray * (1 - sat) + x * sat) for x in c)  # type: ignore[assignment]
    return c


def contrast(y: Column, low: Column, high: Column, cont: float, gamma: float = 1) -> Column:
    """Luma stretched between two of its percentiles, then gamma."""
    share = clamp((clamp(y, low, high) - low) * cont / F.nullif(high - low, F.lit(0)), 0.0, 1.0)
    wide = F.coalesce(to_byte(share * 255), y)
    return to_byte(F.pow(wide / 255, F.lit(1 / gamma)) * 255) if gamma != 1 else wide


def brightened(c: RGB, bright: float) -> RGB:
    """Luma raised by a share of its range."""
    y, u, v = to_yuv(c)
    return to_rgb((F.floor(clamp(y / 255 + bright, 0.0, 1.0) * 255), u, v))


def dark_tweaked(c: RGB, threshold: float = 0.3, amount: float = 0.8) -> RGB:
    """Dark pixels darker and paler: a tweaked copy that fades into the original as it gets brighter."""
    white = min(max(threshold, 0.1), 0.5)
    copy = enhanced(c, bright=-min(max(amount, 0.2), 0.9), sat=min(max(1.1 - amount, 0.1), 0.8))
    return by_luma(copy, c, 0.1) if white == 0.1 else by_luma_gradient(copy, c, 0.1, white)


def bright_chroma(c: RGB, black: float = 0.3, white: float = 0.6, sat: float = 0.8, bright: float = -0.1, rule: str = "") -> RGB:
    """Saturation and brightness of dark pixels lowered, fading into the original between two limits of luma."""
    copy = tweak(c, sat=sat, bright=bright * 255)
    copy = hue_adjusted(copy, rule) if rule else copy
    return by_luma(copy, c, black) if black == white else by_luma_gradient(copy, c, black, white)


def fitted_size(width: Column, height: Column, target: Column | int, even: int = 2, side: str = "height") -> tuple[Column, Column]:
    """A frame's width and height when one side becomes ``target`` and the other keeps the proportion, as an even number."""
    t = target if isinstance(target, Column) else F.lit(target)
    own, other = (height, width) if side == "height" else (width, height)
    free = F.rint(other * t / own).cast("long")
    free = free - free % even if side == "height" else free + free % even
    return (free, t.cast("long")) if side == "height" else (t.cast("long"), free)


def limited_size(width: Column, height: Column, most: tuple[int, int] = (512, 480)) -> tuple[Column, Column]:
    """The shorter side brought down to its limit (width, height), if it is longer; both kept in proportion."""
    low, high = fitted_size(width, height, most[1]), fitted_size(width, height, most[0], side="width")
    wide = height < width
    small = F.when(wide, height <= most[1]).otherwise(width <= most[0])
    return tuple(F.when(small, own).when(wide, a).otherwise(b).cast("long") for own, a, b in zip((width, height), low, high))  # type: ignore[return-value]


def padded_size(width: Column, height: Column, side: int = 512, cell: int = 16) -> tuple[Column, Column, Column, Column]:
    """Width and height in whole cells of a frame scaled into a square, and the margins left and above."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    w, h = (F.floor(x * scale / cell).cast("long") * cell for x in (width, height))
    return w, h, F.floor((side - w) / 2).cast("long"), F.floor((side - h) / 2).cast("long")
