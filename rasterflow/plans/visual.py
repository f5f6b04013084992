"""Queries over pixels and rasters, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blend, color
from ..operators import pixels as px
from ..operators import raster as rs
from .views import GRID, OVERLAYS, PIXELS, TRANSLUCENT, overlays, pixels, rasters, translucent

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _int(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def _round(x: str) -> str:
    return f"floor({x} + 0.5)"


def _channel(x: str) -> str:
    return _int(f"least(255, greatest(0, {_round(x)}))")


# --- point operations on long pixels ---


def _point(name: str, fn, r: str, g: str | None = None, b: str | None = None, more: str = "") -> None:
    """fn changes the pixels; r, g, b are the SQL of the new channels, with {c} for each channel if only r is given."""
    cols = [(r.replace("{c}", c) if g is None else e) for c, e in zip("rgb", (r, g, b), strict=True)]
    QUERIES[name] = lambda spark, sf: fn(pixels(spark, sf))
    SQL[name] = f"WITH {PIXELS}{more} SELECT media_id, y, x, {', '.join(f'{e} AS {c}' for e, c in zip(cols, 'rgb', strict=True))}, a FROM {'t' if more else 'px'}"


def _rgb(fn):
    return lambda df: px.map_pixels(df, fn)


_LUMA = "(0.299 * CAST(r AS DOUBLE) + 0.587 * CAST(g AS DOUBLE) + 0.114 * CAST(b AS DOUBLE))"
_LUM = _int(_round("0.2126 * CAST(r AS DOUBLE) + 0.7152 * CAST(g AS DOUBLE) + 0.0722 * CAST(b AS DOUBLE)"))
_F = 259 * (30 + 255) / (255 * (259 - 30))
_point("brightness", _rgb(lambda p: color.brightness(p, 20)), _channel("{c} + 20.0 / 100 * 255"))
_point("contrast", _rgb(lambda p: color.contrast(p, 30)), _channel(f"CAST({_F!r} AS DOUBLE) * ({{c}} - 128) + 128"))
_point("gamma", _rgb(lambda p: color.gamma(p, 2.2)), _channel("255 * pow(CAST({c} AS DOUBLE) / 255, CAST(1 AS DOUBLE) / 2.2)"))
_point("levels", _rgb(lambda p: color.levels(p, 20, 220, 1.5, 10, 240)), _channel("pow(least(1.0, greatest(0.0, (CAST({c} AS DOUBLE) - 20) / 200)), CAST(1 AS DOUBLE) / 1.5) * 230 + 10"))
_point("invert", _rgb(color.invert), "255 - {c}")
for _method, _sql in (("luminosity", _LUMA), ("average", "(CAST(r AS DOUBLE) + g + b) / 3"), ("lightness", "(CAST(greatest(r, g, b) AS DOUBLE) + least(r, g, b)) / 2")):
    _point(f"grayscale_{_method}", _rgb(lambda p, m=_method: color.grayscale(p, m)), _int(_round(_sql)))
_TONED = ("0.393 * CAST(r AS DOUBLE) + 0.769 * CAST(g AS DOUBLE) + 0.189 * CAST(b AS DOUBLE)", "0.349 * CAST(r AS DOUBLE) + 0.686 * CAST(g AS DOUBLE) + 0.168 * CAST(b AS DOUBLE)", "0.272 * CAST(r AS DOUBLE) + 0.534 * CAST(g AS DOUBLE) + 0.131 * CAST(b AS DOUBLE)")
_point("sepia", _rgb(lambda p: color.sepia(p, 80)), *[_channel(f"CAST({c} AS DOUBLE) * CAST({1 - 0.8!r} AS DOUBLE) + ({t}) * CAST(0.8 AS DOUBLE)") for c, t in zip("rgb", _TONED, strict=True)])
_point("threshold", _rgb(color.threshold), f"CASE WHEN {_LUMA} >= 128 THEN 255 ELSE 0 END")
_point("posterize", _rgb(color.posterize), _int(_round(f"{_round('CAST({c} AS DOUBLE) / 85')} * 85")))

_HSL = """, u AS (SELECT *, CAST(r AS DOUBLE) / 255 AS rn, CAST(g AS DOUBLE) / 255 AS gn, CAST(b AS DOUBLE) / 255 AS bn FROM px
), w AS (SELECT *, greatest(rn, gn, bn) AS hi, least(rn, gn, bn) AS lo FROM u
), hsl AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0.0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s,
  CASE WHEN hi = lo THEN 0.0 WHEN hi = rn THEN ((gn - bn) / (hi - lo) + CASE WHEN gn < bn THEN 6.0 ELSE 0.0 END) / 6 WHEN hi = gn THEN ((bn - rn) / (hi - lo) + 2) / 6 ELSE ((rn - gn) / (hi - lo) + 4) / 6 END AS h FROM w)"""


def _from_hsl(h: str, s: str, light: str) -> tuple[str, list[str]]:
    """CTEs that give t(.., q, p, t0..t2) for hue, saturation and lightness in 0..1, and the channels."""
    ctes = f"""{_HSL}, k AS (SELECT *, {h} AS h2, {s} AS s2, {light} AS l2 FROM hsl), q AS (SELECT *, CASE WHEN l2 < 0.5 THEN l2 * (1 + s2) ELSE l2 + s2 - l2 * s2 END AS q FROM k
), t AS (SELECT *, 2 * l2 - q AS p, {', '.join(f'CASE WHEN h2 + {d} < 0 THEN h2 + {d} + 1 WHEN h2 + {d} > 1 THEN h2 + {d} - 1 ELSE h2 + {d} END AS t{i}' for i, d in enumerate(('CAST(1 AS DOUBLE) / 3', '0.0', '(CAST(-1 AS DOUBLE) / 3)')))} FROM q)"""
    part = lambda t: f"CASE WHEN s2 = 0 THEN l2 WHEN {t} < CAST(1 AS DOUBLE) / 6 THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5 THEN q WHEN {t} < CAST(2 AS DOUBLE) / 3 THEN p + (q - p) * (CAST(2 AS DOUBLE) / 3 - {t}) * 6 ELSE p END"
    return ctes, [_int(_round(f"({part(f't{i}')}) * 255")) for i in range(3)]


_ctes, _cols = _from_hsl("h * 360 / 360", "least(100.0, greatest(0.0, s * 100 + 25)) / 100", "l * 100 / 100")
_point("saturation", lambda df: px.saturate(df, 25), *_cols, more=_ctes)
_ctes, _cols = _from_hsl("((h * 360 + 90 + 360) % 360) / 360", "s * 100 / 100", "l * 100 / 100")
_point("hue_rotate", lambda df: px.rotate_hue(df, 90), *_cols, more=_ctes)
_ctes, _cols = _from_hsl("h * 360 / 360", "s * 100 / 100", "l * 100 / 100")
_point("hsl_to_rgb", lambda df: px.staged(df, color.rgb_to_hsl, color.hsl_to_rgb), *_cols, more=_ctes)


def _spaced(name: str, into, parts: list[str], sql: list[str], ctes: str = "", source: str = "px") -> None:
    QUERIES[name] = lambda spark, sf: pixels(spark, sf).select("media_id", "y", "x", *[F.round(c, 6).alias(n) for n, c in zip(parts, into(px.rgb_of()), strict=True)])
    SQL[name] = f"WITH {PIXELS}{ctes} SELECT media_id, y, x, {', '.join(f'round({e}, 6) AS {n}' for n, e in zip(parts, sql, strict=True))} FROM {source}"


_spaced("rgb_to_hsl", color.rgb_to_hsl, ["h", "s", "l"], ["h * 360", "s * 100", "l * 100"], _HSL, "hsl")
_spaced("rgb_to_hsv", color.rgb_to_hsv, ["h", "s", "v"], ["h * 360", "CASE WHEN hi = 0 THEN 0.0 ELSE (hi - lo) / hi * 100 END", "hi * 100"], _HSL, "hsl")
_K = "(1 - greatest(r, g, b) / CAST(255 AS DOUBLE))"
_spaced("rgb_to_cmyk", color.rgb_to_cmyk, list("cmyk"), [*(f"CASE WHEN greatest(r, g, b) = 0 THEN 0.0 ELSE (1 - {c} / CAST(255 AS DOUBLE) - {_K}) / (1 - {_K}) * 100 END" for c in "rgb"), f"{_K} * 100"])
SQL["rgb_to_cmyk"] = SQL["rgb_to_cmyk"].replace("media_id, y, x,", "media_id, y AS y0, x,").replace(" AS y0", " AS row_no")
QUERIES["rgb_to_cmyk"] = lambda spark, sf: pixels(spark, sf).select("media_id", F.col("y").alias("row_no"), "x", *[F.round(c, 6).alias(n) for n, c in zip("cmyk", color.rgb_to_cmyk(px.rgb_of()), strict=True)])
_LIN = ", ".join(f"CASE WHEN {c} / CAST(255 AS DOUBLE) > 0.04045 THEN pow(({c} / CAST(255 AS DOUBLE) + 0.055) / 1.055, 2.4) ELSE {c} / CAST(255 AS DOUBLE) / 12.92 END AS {c}l" for c in "rgb")
_XYZ = ", ".join(f"({' + '.join(f'CAST({m} AS DOUBLE) * {c}l' for m, c in zip(row, 'rgb', strict=True))}) / CAST({w} AS DOUBLE) AS {n}t" for row, w, n in zip(color.TO_XYZ, color.WHITE, "xyz", strict=True))
_FS = ", ".join(f"CASE WHEN {n}t > 0.008856 THEN pow({n}t, CAST(1 AS DOUBLE) / 3) ELSE (CAST(903.3 AS DOUBLE) * {n}t + 16) / 116 END AS f{n}" for n in "xyz")
_spaced("rgb_to_lab", color.rgb_to_lab, ["lab_l", "lab_a", "lab_b"], ["116 * fy - 16", "500 * (fx - fy)", "200 * (fy - fz)"], f", lin AS (SELECT *, {_LIN} FROM px), xyz AS (SELECT *, {_XYZ} FROM lin), lab AS (SELECT *, {_FS} FROM xyz)", "lab")
# There and back again is the identity on 0..255.
for _name, _into, _back in (("hsv_to_rgb", color.rgb_to_hsv, color.hsv_to_rgb), ("cmyk_to_rgb", color.rgb_to_cmyk, color.cmyk_to_rgb), ("lab_to_rgb", color.rgb_to_lab, color.lab_to_rgb)):
    _point(_name, lambda df, i=_into, o=_back: px.staged(df, i, o), "{c}")

# --- blending ---

_B, _S = "CAST({b} AS DOUBLE)", "CAST({s} AS DOUBLE)"
_BURN = "CASE WHEN {s} = 0 THEN 0.0 ELSE greatest(0.0, 255 - (255 - {b}) * 255.0 / nullif(CAST({s} AS DOUBLE), 0)) END"
_DODGE = "CASE WHEN {s} = 255 THEN 255.0 ELSE least(255.0, {b} * 255 / nullif(255 - CAST({s} AS DOUBLE), 0)) END"
_HARD = "CASE WHEN {s} < 128 THEN 2 * {b} * CAST({s} AS DOUBLE) / 255 ELSE 255 - 2 * (255 - {b}) * (255 - CAST({s} AS DOUBLE)) / 255 END"
_N, _M = "(CAST({b} AS DOUBLE) / 255)", "(CAST({s} AS DOUBLE) / 255)"
_ROOT = f"(CASE WHEN {_N} <= 0.25 THEN ((16 * {_N} - 12) * {_N} + 4) * {_N} ELSE sqrt({_N}) END)"
_BLEND_SQL = {
    "normal": _S,
    "darken": f"least({_B}, {_S})",
    "multiply": f"{_B} * {_S} / 255",
    "colorBurn": _BURN,
    "linearBurn": f"greatest(0.0, {_B} + {_S} - 255)",
    "lighten": f"greatest({_B}, {_S})",
    "screen": f"255 - (255 - {_B}) * (255 - {_S}) / 255",
    "colorDodge": _DODGE,
    "linearDodge": f"least(255.0, {_B} + {_S})",
    "overlay": "CASE WHEN {b} < 128 THEN 2 * {s} * CAST({b} AS DOUBLE) / 255 ELSE 255 - 2 * (255 - {s}) * (255 - CAST({b} AS DOUBLE)) / 255 END",
    "softLight": f"(CASE WHEN {_M} <= 0.5 THEN {_N} - (1 - 2 * {_M}) * {_N} * (1 - {_N}) ELSE {_N} + (2 * {_M} - 1) * ({_ROOT} - {_N}) END) * 255",
    "hardLight": _HARD,
    "vividLight": f"CASE WHEN {{s}} < 128 THEN {_BURN.replace('{s}', '(2 * {s})')} ELSE {_DODGE.replace('{s}', '(2 * ({s} - 128))')} END",
    "linearLight": f"greatest(0.0, least(255.0, {_B} + 2 * {_S} - 255))",
    "pinLight": f"CASE WHEN {{s}} < 128 THEN least({_B}, 2 * {_S}) ELSE greatest({_B}, 2 * ({_S} - 128)) END",
    "hardMix": "CASE WHEN {b} + {s} >= 255 THEN 255.0 ELSE 0.0 END",
    "difference": f"abs({_B} - {_S})",
    "exclusion": f"{_B} + {_S} - 2 * {_B} * {_S} / 255",
    "subtract": f"greatest(0.0, {_B} - {_S})",
    "divide": f"CASE WHEN {{s}} = 0 THEN 255.0 ELSE least(255.0, {_B} * 255 / nullif({_S}, 0)) END",
}


def _composite_sql(channels: list[str], opacity: float, ctes: str = "", source: str | None = None) -> str:
    joined = "mixed AS (SELECT px.*, ov.r AS r2, ov.g AS g2, ov.b AS b2, ov.a AS a2, coalesce(CAST(ov.a AS DOUBLE) / 255 * CAST(%r AS DOUBLE), 0.0) AS share FROM px LEFT JOIN ov USING (media_id, y, x))" % opacity
    cols = [f"CASE WHEN share = 0 THEN {c} ELSE {_int(_round(f'CAST({c} AS DOUBLE) * (1 - share) + ({m}) * share'))} END AS {c}" for c, m in zip("rgb", channels, strict=True)]
    return f"WITH {PIXELS}, {OVERLAYS}, {joined}{ctes} SELECT media_id, y, x, {', '.join(cols)}, CASE WHEN share = 0 THEN a ELSE greatest(a, {_int(_round(f'CAST(a2 AS DOUBLE) * CAST({opacity!r} AS DOUBLE)'))}) END AS a FROM {source or 'mixed'}"


for _mode, _sql in _BLEND_SQL.items():
    QUERIES[f"blend_{_mode}"] = lambda spark, sf, m=_mode: px.composite(pixels(spark, sf), overlays(spark, sf), mode=m, opacity=0.8)
    SQL[f"blend_{_mode}"] = _composite_sql([_sql.replace("{b}", c).replace("{s}", f"{c}2") for c in "rgb"], 0.8)


def _hsl_of(prefix: str, r: str, g: str, b: str) -> str:
    hi, lo = f"(greatest({r}, {g}, {b}) / CAST(255 AS DOUBLE))", f"(least({r}, {g}, {b}) / CAST(255 AS DOUBLE))"
    r, g, b = (f"({c} / CAST(255 AS DOUBLE))" for c in (r, g, b))
    return f"""CASE WHEN {hi} = {lo} THEN 0.0 WHEN {hi} = {r} THEN (({g} - {b}) / ({hi} - {lo}) + CASE WHEN {g} < {b} THEN 6.0 ELSE 0.0 END) / 6 WHEN {hi} = {g} THEN (({b} - {r}) / ({hi} - {lo}) + 2) / 6 ELSE (({r} - {g}) / ({hi} - {lo}) + 4) / 6 END AS {prefix}h,
    CASE WHEN {hi} = {lo} THEN 0.0 WHEN ({hi} + {lo}) / 2 > 0.5 THEN ({hi} - {lo}) / (2 - {hi} - {lo}) ELSE ({hi} - {lo}) / ({hi} + {lo}) END AS {prefix}s, ({hi} + {lo}) / 2 AS {prefix}l"""


for _mode, _take in blend.COMPONENTS.items():
    QUERIES[f"blend_{_mode}"] = lambda spark, sf, m=_mode: px.composite(pixels(spark, sf), overlays(spark, sf), mode=m, opacity=0.8)
    _h2, _s2, _l2 = (f"{'ob'[1 - k]}{n}" for k, n in zip(_take, "hsl", strict=True))
    _third = ("CAST(1 AS DOUBLE) / 3", "0.0", "(CAST(-1 AS DOUBLE) / 3)")
    _ctes = f""", z AS (SELECT *, {_hsl_of('b', 'r', 'g', 'b')}, {_hsl_of('o', 'r2', 'g2', 'b2')} FROM mixed), q AS (SELECT *, CASE WHEN {_l2} < 0.5 THEN {_l2} * (1 + {_s2}) ELSE {_l2} + {_s2} - {_l2} * {_s2} END AS q FROM z
    ), t AS (SELECT *, 2 * {_l2} - q AS p, {', '.join(f'CASE WHEN {_h2} + {d} < 0 THEN {_h2} + {d} + 1 WHEN {_h2} + {d} > 1 THEN {_h2} + {d} - 1 ELSE {_h2} + {d} END AS t{i}' for i, d in enumerate(_third))} FROM q)"""
    _part = [_round(f"(CASE WHEN {_s2} = 0 THEN {_l2} WHEN t{i} < CAST(1 AS DOUBLE) / 6 THEN p + (q - p) * 6 * t{i} WHEN t{i} < 0.5 THEN q WHEN t{i} < CAST(2 AS DOUBLE) / 3 THEN p + (q - p) * (CAST(2 AS DOUBLE) / 3 - t{i}) * 6 ELSE p END) * 255") for i in range(3)]
    SQL[f"blend_{_mode}"] = _composite_sql(_part, 0.8, _ctes, "t")

QUERIES["composite_offset"] = lambda spark, sf: px.composite(pixels(spark, sf), overlays(spark, sf), x=1, opacity=0.5)
SQL["composite_offset"] = _composite_sql([f"CAST({c}2 AS DOUBLE)" for c in "rgb"], 0.5).replace("ov AS (SELECT * FROM tl", "ov AS (SELECT * REPLACE (x + 1 AS x) FROM tl")
QUERIES["premultiply"] = lambda spark, sf: translucent(spark, sf).withColumns(dict(zip("rgb", blend.premultiply(px.rgb_of(), F.col("a")), strict=True)))
SQL["premultiply"] = f"WITH {TRANSLUCENT} SELECT media_id, y, x, {', '.join(f'{_int(_round(f"CAST({c} AS DOUBLE) * a / 255"))} AS {c}' for c in 'rgb')}, a FROM tl"
QUERIES["unpremultiply"] = lambda spark, sf: translucent(spark, sf).withColumns(dict(zip("rgb", blend.unpremultiply(px.rgb_of(), F.col("a")), strict=True)))
SQL["unpremultiply"] = f"WITH {TRANSLUCENT} SELECT media_id, y, x, {', '.join(f'CASE WHEN a = 0 THEN 0 ELSE {_int(f"least(255, {_round(f"CAST({c} AS DOUBLE) * 255 / nullif(a, 0)")})")} END AS {c}' for c in 'rgb')}, a FROM tl"
QUERIES["chroma_key"] = lambda spark, sf: pixels(spark, sf).withColumn("a", blend.chroma_key(px.rgb_of(), (40, 60, 125), 60))
SQL["chroma_key"] = f"WITH {PIXELS}, k AS (SELECT *, sqrt(CAST((r - 40) * (r - 40) + (g - 60) * (g - 60) + (b - 125) * (b - 125) AS DOUBLE)) AS d FROM px) SELECT media_id, y, x, r, g, b, CASE WHEN d <= 60 THEN 0 WHEN d <= 120 THEN {_int(_round('(d - 60) / 60 * 255'))} ELSE 255 END AS a FROM k"
QUERIES["apply_mask"] = lambda spark, sf: px.apply_mask(pixels(spark, sf), _single(translucent(spark, sf)))
SQL["apply_mask"] = f"WITH {PIXELS}, {TRANSLUCENT}, m AS (SELECT media_id, y, x, max(r) AS r, max(g) AS g, max(b) AS b FROM tl GROUP BY ALL) SELECT px.media_id, px.y, px.x, px.r, px.g, px.b, {_int(_round('px.a * (0.299 * CAST(m.r AS DOUBLE) + 0.587 * CAST(m.g AS DOUBLE) + 0.114 * CAST(m.b AS DOUBLE)) / 255'))} AS a FROM px JOIN m USING (media_id, y, x)"


def _single(df: DataFrame) -> DataFrame:
    """One pixel for each place: the greatest of each channel."""
    return df.groupBy("media_id", "y", "x").agg(*[F.max(c).alias(c) for c in "rgba"])


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    over = _single(overlays(spark, sf))
    base = _single(pixels(spark, sf)).withColumns({"a": F.lit(200), "z": F.lit(0), "opacity": F.lit(1.0), "visible": F.lit(True)})
    return base.unionByName(over.withColumns({"z": F.lit(1), "opacity": F.lit(0.5), "visible": F.lit(True)})).unionByName(over.withColumns({"z": F.lit(2), "opacity": F.lit(1.0), "visible": F.lit(False)}))


QUERIES["flatten_layers"] = lambda spark, sf: px.flatten_layers(_layers(spark, sf))
SQL["flatten_layers"] = f"""WITH {PIXELS}, {OVERLAYS}, p1 AS (SELECT media_id, y, x, max(r) AS r, max(g) AS g, max(b) AS b FROM px GROUP BY ALL), o1 AS (SELECT media_id, y, x, max(r) AS r, max(g) AS g, max(b) AS b, max(a) AS a FROM ov GROUP BY ALL), mixed AS (SELECT p1.*, o1.r AS r2, o1.g AS g2, o1.b AS b2, coalesce(CAST(o1.a AS DOUBLE) / 255 * 0.5, 0.0) AS s FROM p1 LEFT JOIN o1 USING (media_id, y, x)),
o AS (SELECT *, s + CAST(200 AS DOUBLE) / 255 * (1 - s) AS oa FROM mixed)
SELECT media_id, y, x, {', '.join(f'CASE WHEN s = 0 THEN {c} ELSE {_int(_round(f"({c}2 * s + {c} * (CAST(200 AS DOUBLE) / 255) * (1 - s)) / oa"))} END AS {c}' for c in 'rgb')}, CASE WHEN s = 0 THEN 200 ELSE {_int(_round('oa * 255'))} END AS a FROM o"""

# --- histograms and tone ---

_HIST = f"""{PIXELS}, c AS (SELECT media_id, unnest(['red', 'green', 'blue', 'alpha', 'luminance']) AS channel, unnest([r, g, b, a, {_LUM}]) AS bin FROM px),
hist AS (SELECT media_id, channel, bin, count(*) AS freq FROM c GROUP BY ALL), run AS (SELECT *, sum(freq) OVER (PARTITION BY media_id, channel ORDER BY bin) AS cum, sum(freq) OVER (PARTITION BY media_id, channel) AS total FROM hist)"""


def _hist(spark: SparkSession, sf: str) -> DataFrame:
    return px.histogram(pixels(spark, sf))


QUERIES["histogram_channels"] = _hist
SQL["histogram_channels"] = f"WITH {_HIST} SELECT media_id, channel, bin, freq FROM hist"
QUERIES["histogram_luminance"] = lambda spark, sf: _hist(spark, sf).where("channel = 'luminance'").groupBy("bin").agg(F.sum("freq").alias("freq"))
SQL["histogram_luminance"] = f"WITH {_HIST} SELECT bin, CAST(sum(freq) AS BIGINT) AS freq FROM hist WHERE channel = 'luminance' GROUP BY bin"
QUERIES["channel_stats"] = lambda spark, sf: px.channel_stats(_hist(spark, sf)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
SQL["channel_stats"] = f"WITH {_HIST} SELECT media_id, channel, min(bin) AS min, max(bin) AS max, round(sum(bin * freq) / CAST(sum(freq) AS DOUBLE), 6) AS mean, round(sqrt(greatest(0.0, sum(bin * bin * freq) / CAST(sum(freq) AS DOUBLE) - pow(sum(bin * freq) / CAST(sum(freq) AS DOUBLE), 2))), 6) AS std, min(bin) FILTER (WHERE cum >= total / 2.0) AS median FROM run GROUP BY media_id, channel"
QUERIES["percentile_bin"] = lambda spark, sf: px.percentile_bins(_hist(spark, sf), p0=0, p25=25, p50=50, p99=99)
SQL["percentile_bin"] = f"WITH {_HIST} SELECT media_id, channel, 0 AS p0, {', '.join(f'min(bin) FILTER (WHERE cum >= total * {p} / 100.0) AS p{p}' for p in (25, 50, 99))} FROM run GROUP BY media_id, channel"
QUERIES["cdf"] = lambda spark, sf: px.cumulative(_hist(spark, sf))
SQL["cdf"] = f"WITH {_HIST} SELECT media_id, channel, bin, CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) AS cdf FROM run"
QUERIES["exposure"] = lambda spark, sf: px.exposure(pixels(spark, sf))
SQL["exposure"] = f"WITH {PIXELS} SELECT media_id, max({_LUM}) - min({_LUM}) < 50 AS low_contrast, avg({_LUM}) < 80 AS underexposed, avg({_LUM}) > 180 AS overexposed FROM px GROUP BY media_id"


def _levels_sql(low: float, high: float, per_channel: bool) -> str:
    first = lambda p: "0" if p <= 0 else f"coalesce(min(bin) FILTER (WHERE cum >= total * CAST({p!r} AS DOUBLE) / 100), 255)"
    names = dict(zip("rgb", ("red", "green", "blue") if per_channel else ("luminance",) * 3, strict=True))
    bounds = f"bounds AS (SELECT media_id, channel, {first(low)} AS lo, {first(high)} AS hi FROM run GROUP BY media_id, channel)"
    cols = [f"CASE WHEN {c}b.hi <= {c}b.lo THEN 128 WHEN {c} <= {c}b.lo THEN 0 WHEN {c} >= {c}b.hi THEN 255 ELSE {_int(_round(f'CAST({c} - {c}b.lo AS DOUBLE) / ({c}b.hi - {c}b.lo) * 255'))} END AS {c}" for c in "rgb"]
    return f"WITH {_HIST}, {bounds} SELECT px.media_id, y, x, {', '.join(cols)}, a FROM px {' '.join(f"JOIN bounds {c}b ON {c}b.media_id = px.media_id AND {c}b.channel = '{n}'" for c, n in names.items())}"


QUERIES["auto_levels"] = lambda spark, sf: px.auto_levels(pixels(spark, sf), 20, 20)
SQL["auto_levels"] = _levels_sql(20, 80, False)
QUERIES["auto_levels_per_channel"] = lambda spark, sf: px.auto_levels(pixels(spark, sf), 20, 20, per_channel=True)
SQL["auto_levels_per_channel"] = _levels_sql(20, 80, True)
QUERIES["auto_contrast"] = lambda spark, sf: px.auto_contrast(pixels(spark, sf))
SQL["auto_contrast"] = _levels_sql(0.5, 99.5, False)
QUERIES["normalize"] = lambda spark, sf: px.normalize(pixels(spark, sf))
SQL["normalize"] = _levels_sql(0, 100, True)
QUERIES["equalize"] = lambda spark, sf: px.equalize(pixels(spark, sf))
SQL["equalize"] = f"""WITH {_HIST}, cdf AS (SELECT media_id, bin, CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) AS cdf FROM run WHERE channel = 'luminance'), f AS (SELECT *, min(cdf) OVER (PARTITION BY media_id) AS least FROM cdf),
lut AS (SELECT media_id, bin, CASE WHEN least = 1 THEN 0 ELSE {_int(_round('(cdf - least) / nullif(1 - least, 0) * 255'))} END AS lum2 FROM f), p AS (SELECT *, {_LUM} AS lum FROM px)
SELECT p.media_id, y, x, {', '.join(f'CASE WHEN lum = 0 THEN lum2 ELSE {_channel(f"{c} * (CAST(lum2 AS DOUBLE) / nullif(lum, 0))")} END AS {c}' for c in 'rgb')}, a FROM p JOIN lut ON lut.media_id = p.media_id AND lut.bin = p.lum"""
QUERIES["match_histogram"] = lambda spark, sf: px.match_histogram(pixels(spark, sf), pixels(spark, sf).where("media_id < 64").withColumn("media_id", F.lit(0)))
SQL["match_histogram"] = f"""WITH {_HIST}, cdf AS (SELECT media_id, channel, bin, CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) AS cdf FROM run),
ref AS (SELECT channel, bin, count(*) AS freq FROM c WHERE media_id < 64 GROUP BY ALL), rd AS (SELECT ch.channel, b.bin, coalesce(freq, 0) AS freq FROM (SELECT DISTINCT channel FROM ref) ch CROSS JOIN (SELECT unnest(range(0, 256)) AS bin) b LEFT JOIN ref ON ref.channel = ch.channel AND ref.bin = b.bin),
rc AS (SELECT channel, bin, CAST(sum(freq) OVER (PARTITION BY channel ORDER BY bin) AS DOUBLE) / CAST(sum(freq) OVER (PARTITION BY channel) AS DOUBLE) AS cdf FROM rd),
lut AS (SELECT media_id, channel, bin, CAST(best AS INTEGER) AS best FROM (SELECT cdf.*, rc.bin AS best, row_number() OVER (PARTITION BY media_id, cdf.channel, cdf.bin ORDER BY abs(rc.cdf - cdf.cdf), rc.bin) AS n FROM cdf JOIN rc ON rc.channel = cdf.channel) WHERE n = 1)
SELECT px.media_id, y, x, lr.best AS r, lg.best AS g, lb.best AS b, a FROM px {' '.join(f"JOIN lut l{c} ON l{c}.media_id = px.media_id AND l{c}.channel = '{n}' AND l{c}.bin = px.{c}" for c, n in zip('rgb', ('red', 'green', 'blue'), strict=True))}"""

# --- geometry and filters on 8 by 8 rasters ---

W = H = 8


def _gray(name: str, fn, sql: str, w: int = W, h: int = H) -> None:
    """fn gives the new channel from F.col('v'), or new rasters from rasters if it is marked; sql selects media_id, y, x, v from g."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = rasters(spark, sf)
        df = fn(df) if getattr(fn, "whole", False) else df.withColumns({"v": fn(F.col("v")), "width": F.lit(w), "height": F.lit(h)})
        return rs.unpack(df, ("v",))

    QUERIES[name] = run
    SQL[name] = f"WITH {GRID} {sql}"


def _whole(fn):
    fn.whole = True
    return fn


_gray("flip_horizontal", lambda v: rs.flip_horizontal(v, W, H), "SELECT media_id, y, 7 - x AS x, v FROM g")
_gray("flip_vertical", lambda v: rs.flip_vertical(v, W, H), "SELECT media_id, 7 - y AS y, x, v FROM g")
_gray("flip_both", lambda v: rs.flip_both(v, W, H), "SELECT media_id, 7 - y AS y, 7 - x AS x, v FROM g")
_gray("rotate_90", lambda v: rs.rotate_90(v, W, H), "SELECT media_id, x AS y, 7 - y AS x, v FROM g")
_gray("rotate_180", lambda v: rs.rotate_180(v, W, H), "SELECT media_id, 7 - y AS y, 7 - x AS x, v FROM g")
_gray("rotate_270", lambda v: rs.rotate_270(v, W, H), "SELECT media_id, 7 - x AS y, y AS x, v FROM g")
_gray("crop", lambda v: rs.crop(v, W, H, 2, 1, 5, 4), "SELECT media_id, y - 1 AS y, x - 2 AS x, v FROM g WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4", 5, 4)
_gray("extend", lambda v: rs.extend(v, W, H, 1, 2, 0, 1, 77), "SELECT m.media_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, coalesce(v, 77) AS v FROM (SELECT DISTINCT media_id FROM g) m CROSS JOIN (SELECT unnest(range(0, 9)) AS yy) CROSS JOIN (SELECT unnest(range(0, 11)) AS xx) LEFT JOIN g ON g.media_id = m.media_id AND g.y = yy - 1 AND g.x = xx - 1", 11, 9)
_gray("resize_nearest", lambda v: rs.resize_nearest(v, W, H, 12, 5), "SELECT media_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, v FROM (SELECT unnest(range(0, 5)) AS yy) CROSS JOIN (SELECT unnest(range(0, 12)) AS xx) JOIN g ON y = CAST(floor(yy * CAST(8 AS DOUBLE) / 5) AS INTEGER) AND x = CAST(floor(xx * (CAST(8 AS DOUBLE) / 12)) AS INTEGER)", 12, 5)


def _resample_sql(reach: range, weight: str, normalise: bool) -> str:
    wx, wy = weight.replace("{t}", "(sx - x0 - i)"), weight.replace("{t}", "(sy - y0 - j)")
    return f""", n AS (SELECT yy, xx, yy * (CAST(8 AS DOUBLE) / 5) AS sy, xx * (CAST(8 AS DOUBLE) / 12) AS sx FROM (SELECT unnest(range(0, 5)) AS yy) CROSS JOIN (SELECT unnest(range(0, 12)) AS xx)), f AS (SELECT *, floor(sy) AS y0, floor(sx) AS x0 FROM n),
    k AS (SELECT yy, xx, CAST(least(7, greatest(0, y0 + j)) AS INTEGER) AS y1, CAST(least(7, greatest(0, x0 + i)) AS INTEGER) AS x1, ({wx}) * ({wy}) AS w FROM f CROSS JOIN (SELECT unnest(range({reach.start}, {reach.stop})) AS j) CROSS JOIN (SELECT unnest(range({reach.start}, {reach.stop})) AS i))
    SELECT media_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, {_channel('sum(v * w) / sum(w)' if normalise else 'sum(v * w)')} AS v FROM k JOIN g ON g.y = y1 AND g.x = x1 GROUP BY media_id, yy, xx"""


_CUBIC = "CASE WHEN abs({t}) <= 1 THEN 1.5 * pow(abs({t}), 3) - 2.5 * pow(abs({t}), 2) + 1 WHEN abs({t}) < 2 THEN -0.5 * pow(abs({t}), 3) + 2.5 * pow(abs({t}), 2) - 4 * abs({t}) + 2 ELSE 0 END"
_LANCZOS = "CASE WHEN {t} = 0 THEN 1 WHEN abs({t}) >= 3 THEN 0 ELSE 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / nullif(pi() * {t} * pi() * {t}, 0) END"
_gray("resize_bilinear", lambda v: rs.resize_bilinear(v, W, H, 12, 5), _resample_sql(range(2), "1 - abs({t})", False), 12, 5)
_gray("resize_bicubic", lambda v: rs.resize_bicubic(v, W, H, 12, 5), _resample_sql(range(-1, 3), _CUBIC, False), 12, 5)
_gray("resize_lanczos", lambda v: rs.resize_lanczos(v, W, H, 12, 5), _resample_sql(range(-2, 4), _LANCZOS, True), 12, 5)


def _rotated(spark: SparkSession, sf: str) -> DataFrame:
    turned, w, h = rs.rotate(F.col("v"), W, H, 30, 9)
    return rs.unpack(rasters(spark, sf).withColumns({"v": turned, "width": F.lit(w), "height": F.lit(h)}), ("v",))


QUERIES["rotate_any"] = _rotated
_cos, _sin = math.cos(math.radians(30)), math.sin(math.radians(30))
_n = math.ceil(8 * _cos + 8 * _sin)
SQL["rotate_any"] = f"""WITH {GRID}, n AS (SELECT yy, xx, (xx - {_n / 2}) * CAST({_cos!r} AS DOUBLE) + (yy - {_n / 2}) * CAST({_sin!r} AS DOUBLE) + 4.0 AS sx, (xx - {_n / 2}) * CAST({-_sin!r} AS DOUBLE) + (yy - {_n / 2}) * CAST({_cos!r} AS DOUBLE) + 4.0 AS sy FROM (SELECT unnest(range(0, {_n})) AS yy) CROSS JOIN (SELECT unnest(range(0, {_n})) AS xx)),
f AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM n WHERE sx >= 0 AND sx < 7 AND sy >= 0 AND sy < 7), ids AS (SELECT DISTINCT media_id FROM g),
m AS (SELECT a.media_id, yy, xx, a.v * (1 - fx) + b.v * fx AS top, c.v * (1 - fx) + d.v * fx AS low, fy FROM f JOIN g a ON a.x = x0 AND a.y = y0 JOIN g b ON b.media_id = a.media_id AND b.x = x0 + 1 AND b.y = y0 JOIN g c ON c.media_id = a.media_id AND c.x = x0 AND c.y = y0 + 1 JOIN g d ON d.media_id = a.media_id AND d.x = x0 + 1 AND d.y = y0 + 1)
SELECT ids.media_id, CAST(n.yy AS INTEGER) AS y, CAST(n.xx AS INTEGER) AS x, coalesce({_int(_round('top * (1 - fy) + low * fy'))}, 9) AS v FROM ids CROSS JOIN n LEFT JOIN m ON m.media_id = ids.media_id AND m.yy = n.yy AND m.xx = n.xx"""

QUERIES["auto_crop"] = lambda spark, sf: rs.auto_crop_box(rasters(spark, sf), ("v",), 100)
SQL["auto_crop"] = f"WITH {GRID}, o AS (SELECT media_id, v AS v0 FROM g WHERE x = 0 AND y = 0), b AS (SELECT media_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM g JOIN o USING (media_id) WHERE abs(v - v0) > 100 GROUP BY media_id) SELECT media_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(width, 0) AS width, coalesce(height, 0) AS height FROM o LEFT JOIN b USING (media_id)"


def _kernel_sql(source: str, kernel: list[list[float]], divisor: float, offset: float = 0, edge: str = "clamp", rounded: bool = True) -> str:
    cy, cx = len(kernel) // 2, len(kernel[0]) // 2
    taps = ", ".join(f"({j - cy}, {i - cx}, CAST({v!r} AS DOUBLE))" for j, row in enumerate(kernel) for i, v in enumerate(row) if v)

    def at(e: str) -> str:
        if edge == "wrap":
            return f"(({e} + 8) % 8)"
        if edge == "mirror":
            e = f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= 8 THEN 16 - ({e}) - 1 ELSE {e} END"
        return f"least(7, greatest(0, {e}))"

    y, x = at("p.y + dy"), at("p.x + dx")
    if edge == "zero":
        out = "(p.y + dy < 0 OR p.y + dy > 7 OR p.x + dx < 0 OR p.x + dx > 7)"
        y, x = f"CASE WHEN {out} THEN 0 ELSE p.y + dy END", f"CASE WHEN {out} THEN 0 ELSE p.x + dx END"
    return f"SELECT p.media_id, p.y, p.x, {_channel(f'sum(q.v * w) / CAST({divisor!r} AS DOUBLE) + {offset}')} AS v FROM {source} p CROSS JOIN (VALUES {taps}) k(dy, dx, w) JOIN {source} q ON q.media_id = p.media_id AND q.y = {y} AND q.x = {x} GROUP BY p.media_id, p.y, p.x"


_SOFT = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
for _e in rs.EDGES:
    _gray(f"convolve_{_e}", lambda v, e=_e: rs.convolve(v, W, H, _SOFT, edge=e), _kernel_sql("g", _SOFT, 16, edge=_e))
_G1 = rs.gaussian_kernel(1)
_BLURRED = f", h1 AS MATERIALIZED ({_kernel_sql('g', [_G1], 1)}), h2 AS MATERIALIZED ({_kernel_sql('h1', [[v] for v in _G1], 1)})"
_gray("gaussian_blur", _whole(lambda df: rs.gaussian_blur(df, ("v",), 1)), f"{_BLURRED} SELECT * FROM h2")
_gray("box_blur", _whole(lambda df: rs.box_blur(df, ("v",), 1)), f", h1 AS MATERIALIZED ({_kernel_sql('g', [[1.0] * 3], 3)}) {_kernel_sql('h1', [[1.0]] * 3, 3)}")
_gray("sharpen", _whole(lambda df: rs.sharpen(df, ("v",), 150, 1)), f"{_BLURRED} SELECT g.media_id, g.y, g.x, {_channel('g.v + 150.0 / 100 * (g.v - h2.v)')} AS v FROM g JOIN h2 USING (media_id, y, x)")


def _edges_sql(kernels: tuple, source: str = "g") -> str:
    return f", gx AS ({_kernel_sql(source, kernels[0], 1)}), gy AS ({_kernel_sql(source, kernels[1], 1)}) SELECT media_id, y, x, {_channel('sqrt(CAST((gx.v - 128) * (gx.v - 128) + (gy.v - 128) * (gy.v - 128) AS DOUBLE))')} AS v FROM gx JOIN gy USING (media_id, y, x)"


_gray("sobel", _whole(lambda df: rs.gradient_edges(df, "v", rs.SOBEL)), _edges_sql(rs.SOBEL))
_gray("prewitt", _whole(lambda df: rs.gradient_edges(df, "v", rs.PREWITT)), _edges_sql(rs.PREWITT))
_gray("canny", _whole(lambda df: rs.gradient_edges(rs.gaussian_blur(df, ("v",), 1), "v", rs.SOBEL)), _BLURRED + _edges_sql(rs.SOBEL, "h2"))
_gray("laplacian", lambda v: rs.laplacian(v, W, H), _kernel_sql("g", rs.LAPLACIAN, 1, 128))
_gray("emboss", lambda v: rs.convolve(v, W, H, rs.emboss_kernel(), 1, 128), _kernel_sql("g", rs.EMBOSS_LEFT, 1, 128))
_NEAR = "FROM g p CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) JOIN g q ON q.media_id = p.media_id AND q.y = least(7, greatest(0, p.y + dy)) AND q.x = least(7, greatest(0, p.x + dx)) GROUP BY p.media_id, p.y, p.x"
_gray("median", lambda v: rs.median(v, W, H, 1), f"SELECT p.media_id, p.y, p.x, list_sort(list(q.v))[5] AS v {_NEAR}")
_WT = "exp(-(dx * dx + dy * dy) / CAST(0.5 AS DOUBLE)) * exp(-(3 * (q.v - p.v) * (q.v - p.v)) / CAST(1800 AS DOUBLE))"
_gray("bilateral", lambda v: rs.bilateral(v, W, H, 1), f"SELECT p.media_id, p.y, p.x, {_int(_round(f'sum(q.v * {_WT}) / sum({_WT})'))} AS v {_NEAR}")


def _colours(spark: SparkSession, sf: str) -> DataFrame:
    """The gray rasters in colour: green mirrored, blue upside down."""
    return rasters(spark, sf).withColumns({"r": F.col("v"), "g": rs.flip_horizontal(F.col("v"), W, H), "b": rs.flip_vertical(F.col("v"), W, H)}).drop("v")


_COLOURS = f"{GRID}, cg AS MATERIALIZED (SELECT p.media_id, p.y, p.x, p.v AS r, q.v AS g, s.v AS b FROM g p JOIN g q ON q.media_id = p.media_id AND q.y = p.y AND q.x = 7 - p.x JOIN g s ON s.media_id = p.media_id AND s.y = 7 - p.y AND s.x = p.x)"
_NEAR_RGB = _NEAR.replace("FROM g p", "FROM cg p").replace("JOIN g q", "JOIN cg q")
_WT_RGB = "exp(-(dx * dx + dy * dy) / CAST(0.5 AS DOUBLE)) * exp(-((q.r - p.r) * (q.r - p.r) + (q.g - p.g) * (q.g - p.g) + (q.b - p.b) * (q.b - p.b)) / CAST(1800 AS DOUBLE))"
QUERIES["bilateral_colour"] = lambda spark, sf: rs.unpack(rs.denoise(_colours(spark, sf), algorithm="bilateral"), tuple("rgb"))
SQL["bilateral_colour"] = f"WITH {_COLOURS} SELECT p.media_id, p.y, p.x, {', '.join(_int(_round(f'sum(q.{c} * {_WT_RGB}) / sum({_WT_RGB})')) + f' AS {c}' for c in 'rgb')} {_NEAR_RGB}"
QUERIES["denoise_median"] = lambda spark, sf: rs.unpack(rs.denoise(_colours(spark, sf)), tuple("rgb"))
SQL["denoise_median"] = f"WITH {_COLOURS} SELECT p.media_id, p.y, p.x, {', '.join(f'list_sort(list(q.{c}))[5] AS {c}' for c in 'rgb')} {_NEAR_RGB}"
