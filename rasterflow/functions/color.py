"""Point operations on channel columns, and colour spaces. Channels are 0..255; hue is 0..360, other parts 0..100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import channel, clamp, half_up

Rgb = tuple[Column, Column, Column]


def d(c: Column) -> Column:
    return c.cast("double")


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * d(r) + 0.587 * d(g) + 0.114 * d(b)


def luminance709(r: Column, g: Column, b: Column) -> Column:
    return half_up(0.2126 * d(r) + 0.7152 * d(g) + 0.0722 * d(b)).cast("int")


def each(fn, rgb: Rgb) -> Rgb:
    return tuple(fn(c) for c in rgb)


def brightness(rgb: Rgb, amount: float) -> Rgb:
    return each(lambda c: channel(d(c) + amount / 100 * 255), rgb)


def contrast(rgb: Rgb, amount: float) -> Rgb:
    factor = 259 * (amount + 255) / (255 * (259 - amount))
    return each(lambda c: channel(factor * (d(c) - 128) + 128), rgb)


def gamma(rgb: Rgb, value: float) -> Rgb:
    return each(lambda c: channel(255 * F.pow(d(c) / 255, F.lit(1 / value))), rgb)


def levels(rgb: Rgb, black: float = 0, white: float = 255, mid: float = 1, out_black: float = 0, out_white: float = 255) -> Rgb:
    return each(lambda c: channel(F.pow(clamp((d(c) - black) / (white - black), 0.0, 1.0), F.lit(1 / mid)) * (out_white - out_black) + out_black), rgb)


def invert(rgb: Rgb) -> Rgb:
    return each(lambda c: (255 - c).cast("int"), rgb)


def grayscale(rgb: Rgb, method: str = "luminosity") -> Rgb:
    r, g, b = rgb
    gray = {"luminosity": lambda: luma601(r, g, b), "average": lambda: (d(r) + d(g) + d(b)) / 3, "lightness": lambda: (d(F.greatest(r, g, b)) + d(F.least(r, g, b))) / 2}[method]()
    return (half_up(gray).cast("int"),) * 3


def sepia(rgb: Rgb, amount: float = 100) -> Rgb:
    r, g, b = map(d, rgb)
    t = amount / 100
    toned = (0.393 * r + 0.769 * g + 0.189 * b, 0.349 * r + 0.686 * g + 0.168 * b, 0.272 * r + 0.534 * g + 0.131 * b)
    return tuple(channel(c * (1 - t) + s * t) for c, s in zip((r, g, b), toned, strict=True))


def threshold(rgb: Rgb, at: float = 128) -> Rgb:
    return (F.when(luma601(*rgb) >= at, 255).otherwise(0).cast("int"),) * 3


def posterize(rgb: Rgb, count: int = 4) -> Rgb:
    step = 255 / (count - 1)
    return each(lambda c: half_up(half_up(d(c) / step) * step).cast("int"), rgb)


def _hue(r: Column, g: Column, b: Column, high: Column, spread: Column) -> Column:
    """0..1; ties go to red, then green."""
    sector = F.when(high == r, (g - b) / spread + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    return F.when(spread == 0, F.lit(0.0)).otherwise(sector / 6)


def hsl_unit(rgb: Rgb) -> Rgb:
    r, g, b = each(lambda c: d(c) / 255, rgb)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, spread = (high + low) / 2, high - low
    sat = F.when(spread == 0, F.lit(0.0)).when(light > 0.5, spread / (2 - high - low)).otherwise(spread / (high + low))
    return _hue(r, g, b, high, spread), sat, light


def rgb_to_hsl(rgb: Rgb) -> Rgb:
    h, s, light = hsl_unit(rgb)
    return h * 360, s * 100, light * 100


def unit_to_rgb(h: Column, s: Column, light: Column) -> Rgb:
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q

    def part(t: Column) -> Column:
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    return tuple(half_up(F.when(s == 0, light).otherwise(part(h + shift)) * 255).cast("int") for shift in (1 / 3, 0.0, -1 / 3))


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Rgb:
    return unit_to_rgb(h / 360, s / 100, light / 100)


def saturation(rgb: Rgb, amount: float) -> Rgb:
    h, s, light = rgb_to_hsl(rgb)
    return hsl_to_rgb(h, clamp(s + amount, 0.0, 100.0), light)


def hue_rotate(rgb: Rgb, degrees: float) -> Rgb:
    h, s, light = rgb_to_hsl(rgb)
    return hsl_to_rgb((h + degrees + 360) % 360, s, light)


def rgb_to_hsv(rgb: Rgb) -> Rgb:
    r, g, b = each(lambda c: d(c) / 255, rgb)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return _hue(r, g, b, high, high - low) * 360, F.when(high == 0, F.lit(0.0)).otherwise((high - low) / high) * 100, high * 100


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Rgb:
    h, s, v = h / 360, s / 100, v / 100
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    i = F.pmod(i, F.lit(6))
    pick = lambda *o: half_up(F.when(i == 0, o[0]).when(i == 1, o[1]).when(i == 2, o[2]).when(i == 3, o[3]).when(i == 4, o[4]).otherwise(o[5]) * 255).cast("int")
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def rgb_to_cmyk(rgb: Rgb) -> tuple[Column, Column, Column, Column]:
    r, g, b = each(lambda c: d(c) / 255, rgb)
    k = 1 - F.greatest(r, g, b)
    return *(F.when(k == 1, F.lit(0.0)).otherwise((1 - c - k) / (1 - k) * 100) for c in (r, g, b)), k * 100


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Rgb:
    return tuple(half_up(255 * (1 - x / 100) * (1 - k / 100)).cast("int") for x in (c, m, y))


# D65 white, sRGB matrix and its inverse, CIE constants.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
EPSILON, KAPPA = 0.008856, 903.3


def rgb_to_lab(rgb: Rgb) -> Rgb:
    linear = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in each(lambda c: d(c) / 255, rgb)]
    xyz = [sum(m * c for m, c in zip(row, linear, strict=True)) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    fx, fy, fz = (F.when(t > EPSILON, F.pow(t, F.lit(1 / 3))).otherwise((KAPPA * t + 16) / 116) for t in xyz)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def lab_to_rgb(light: Column, a: Column, b: Column) -> Rgb:
    fy = (light + 16) / 116
    cubes = [F.when(F.pow(f, F.lit(3.0)) > EPSILON, F.pow(f, F.lit(3.0))).otherwise((116 * f - 16) / KAPPA) * w for f, w in zip((a / 500 + fy, fy, fy - b / 200), WHITE, strict=True)]
    linear = [sum(m * c for m, c in zip(row, cubes, strict=True)) for row in TO_RGB]
    return tuple(channel(255 * F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)) for c in linear)
