"""Named bundles of parameters, resolved to operator chains before anything runs.

A preset is data: ``compose`` checks it and gives a function from a DataFrame with two colourings (r, g, b and r2, g2, b2) to
one with the merged, adjusted colour (or, og, ob). Neural scoring is a hook: whatever fills r2, g2, b2.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.functions.numeric import to_byte
from tidemark.operators import pixels, temporal

#: Speed names and the factor each stands for, from the slowest.
SPEEDS = {
    "placebo": 32,
    "veryslow": 32,
    "slower": 32,
    "slow": 28,
    "medium": 24,
    "fast": 22,
    "faster": 20,
    "veryfast": 16,
}
#: Blend names and their merge methods.
BLENDS = {
    "simple": 2,
    "constrained-chroma": 3,
    "luma-masked": 4,
    "adaptive-luma": 5,
    "chroma-retention": 6,
    "chromabound-adaptive": 7,
}
#: Tune names and the second colouring's weight.
TUNES = {
    "verystable": 0.2,
    "morestable": 0.3,
    "stable": 0.4,
    "balanced": 0.5,
    "vivid": 0.6,
    "morevivid": 0.7,
    "veryvivid": 0.8,
}


@dataclass(frozen=True)
class Preset:
    """A checked bundle."""

    speed: str = "medium"
    blend: str = "simple"
    tune: str = "stable"
    hue_rule: str = ""
    saturation: float = 1.0
    brightness: float = 0.0

    def __post_init__(self) -> None:
        for value, known in ((self.speed, SPEEDS), (self.blend, BLENDS), (self.tune, TUNES)):
            if value.lower() not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        if not 0 <= self.saturation <= 10 or not -255 <= self.brightness <= 255:
            raise ValueError("saturation must lie in [0, 10], brightness in [-255, 255]")
        if self.hue_rule:
            pixels.parse_hues(self.hue_rule.partition("|")[0])

    @property
    def factor(self) -> int:
        """Size factor for the scoring hook: samples a side, in units of 16."""
        return SPEEDS[self.speed.lower()]


def compose(preset: Preset) -> Callable[[DataFrame], DataFrame]:
    """The chain: merge, then hue rule, then tweak; steps whose parameters change nothing are left out."""

    def run(df: DataFrame) -> DataFrame:
        a, b = pixels.rgb("r", "g", "b"), pixels.rgb("r2", "g2", "b2")
        c = pixels.merge(a, b, BLENDS[preset.blend.lower()], TUNES[preset.tune.lower()])
        df = df.withColumns(dict(zip(("or", "og", "ob"), c)))
        out = pixels.rgb("or", "og", "ob")
        if preset.hue_rule:
            df = df.withColumns(dict(zip(("or", "og", "ob"), pixels.hue_adjusted(out, preset.hue_rule))))
        if preset.saturation != 1 or preset.brightness:
            df = df.withColumns(dict(zip(("or", "og", "ob"), pixels.tweak(out, sat=preset.saturation, bright=preset.brightness))))
        return df

    return run


def stabilised(
    dark: tuple[float, float] | None = (0.3, 0.8), smooth: tuple[float, float, float, float] | None = None, hue_rule: str = "", frames: int = 0,
    gray: float = 0.0, near: float = 256.0,
) -> Callable[[DataFrame], DataFrame]:
    """A clip's colours (clip_id, n, r, g, b) steadied: dark tweak, chroma by brightness, hue rule, centred mean over frames.

    The order is fixed, and steps that aren't asked for are left out. In the mean a frame whose saturation is below ``gray``, or
    that is further off than ``near``, counts as the frame itself.
    """

    def run(df: DataFrame) -> DataFrame:
        own = pixels.rgb("r", "g", "b")
        if dark:
            df = df.withColumns(dict(zip("rgb", pixels.dark_tweaked(own, *dark))))
        if smooth:
            black, white, sat, bright = smooth
            df = df.withColumns(dict(zip("rgb", pixels.bright_chroma(own, black, white, sat, -bright))))
        if hue_rule:
            df = df.withColumns(dict(zip("rgb", pixels.hue_adjusted(own, hue_rule))))
        if frames > 1:
            pale = pixels.saturation(own) < gray
            mean = [to_byte(temporal.repaired_average(c, temporal.even_weights(frames), pale, near)) for c in "rgb"]
            df = df.withColumns(dict(zip("rgb", mean)))
        return df

    return run


def main(preset: Preset) -> Callable[[DataFrame], DataFrame]:
    """The whole chain of a preset by its speed: the two slowest also tweak dark pixels of what was merged."""
    merged = compose(preset)
    if preset.speed.lower() not in ("placebo", "veryslow"):
        return merged

    def run(df: DataFrame) -> DataFrame:
        return merged(df).withColumns(dict(zip(("or", "og", "ob"), pixels.dark_tweaked(pixels.rgb("or", "og", "ob")))))

    return run
