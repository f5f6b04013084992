"""The 24 blend modes as column functions of a base and a blend channel, and compositing of two pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import Rgb, d, hsl_unit, unit_to_rgb
from .rounding import half_up


def _burn(b: Column, s: Column) -> Column:
    return F.when(s == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 255 - (255 - b) * 255 / F.when(s != 0, s)))


def _dodge(b: Column, s: Column) -> Column:
    return F.when(s == 255, F.lit(255.0)).otherwise(F.least(F.lit(255.0), b * 255 / F.when(s != 255, 255 - s)))


def _hard(b: Column, s: Column) -> Column:
    return F.when(s < 128, 2 * b * s / 255).otherwise(255 - 2 * (255 - b) * (255 - s) / 255)


def _soft(base: Column, blend: Column) -> Column:
    b, s = base / 255, blend / 255
    root = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (root - b)) * 255


BLENDS: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda b, s: s,
    "darken": lambda b, s: F.least(b, s),
    "multiply": lambda b, s: b * s / 255,
    "colorBurn": _burn,
    "linearBurn": lambda b, s: F.greatest(F.lit(0.0), b + s - 255),
    "lighten": lambda b, s: F.greatest(b, s),
    "screen": lambda b, s: 255 - (255 - b) * (255 - s) / 255,
    "colorDodge": _dodge,
    "linearDodge": lambda b, s: F.least(F.lit(255.0), b + s),
    "overlay": lambda b, s: _hard(s, b),
    "softLight": _soft,
    "hardLight": _hard,
    "vividLight": lambda b, s: F.when(s < 128, _burn(b, 2 * s)).otherwise(_dodge(b, 2 * (s - 128))),
    "linearLight": lambda b, s: F.greatest(F.lit(0.0), F.least(F.lit(255.0), b + 2 * s - 255)),
    "pinLight": lambda b, s: F.when(s < 128, F.least(b, 2 * s)).otherwise(F.greatest(b, 2 * (s - 128))),
    "hardMix": lambda b, s: F.when(b + s >= 255, F.lit(255.0)).otherwise(F.lit(0.0)),
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s / 255,
    "subtract": lambda b, s: F.greatest(F.lit(0.0), b - s),
    "divide": lambda b, s: F.when(s == 0, F.lit(255.0)).otherwise(F.least(F.lit(255.0), b * 255 / F.when(s != 0, s))),
}
#: Which of hue, saturation and lightness come from the blend colour.
COMPONENTS = {"hue": (1, 0, 0), "saturation": (0, 1, 0), "color": (1, 1, 0), "luminosity": (0, 0, 1)}
MODES = (*BLENDS, *COMPONENTS)


def blend(base: Rgb, over: Rgb, mode: str) -> Rgb:
    """Unrounded, but for the component modes."""
    if mode in COMPONENTS:
        return unit_to_rgb(*(o if take else b for b, o, take in zip(hsl_unit(base), hsl_unit(over), COMPONENTS[mode], strict=True)))
    return tuple(BLENDS[mode](d(b), d(o)) for b, o in zip(base, over, strict=True))


def composite(base: Rgb, base_a: Column, over: Rgb, over_a: Column, mode: str = "normal", opacity: float = 1.0) -> tuple[Column, Column, Column, Column]:
    """over on base; the alpha is the greater one. A missing (null) or transparent overlay leaves the base."""
    share = F.coalesce(d(over_a) / 255 * opacity, F.lit(0.0))
    colours = (F.when(share == 0, b).otherwise(half_up(d(b) * (1 - share) + d(m) * share)).cast("int") for b, m in zip(base, blend(base, over, mode), strict=True))
    return *colours, F.when(share == 0, base_a).otherwise(F.greatest(base_a, half_up(d(over_a) * opacity))).cast("int")


def premultiply(rgb: Rgb, a: Column) -> Rgb:
    return tuple(half_up(d(c) * d(a) / 255).cast("int") for c in rgb)


def unpremultiply(rgb: Rgb, a: Column) -> Rgb:
    return tuple(F.when(a == 0, 0).otherwise(F.least(F.lit(255), half_up(d(c) * 255 / F.when(a != 0, d(a))))).cast("int") for c in rgb)


def chroma_key(rgb: Rgb, key: tuple[int, int, int], tolerance: float = 30) -> Column:
    """The new alpha: 0 within tolerance of the key colour, 255 beyond twice that, linear between."""
    far = F.sqrt(sum((d(c) - k) * (d(c) - k) for c, k in zip(rgb, key, strict=True)))
    return F.when(far <= tolerance, F.lit(0)).when(far <= 2 * tolerance, half_up((far - tolerance) / tolerance * 255)).otherwise(F.lit(255)).cast("int")
