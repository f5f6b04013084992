"""Operators over long pixels (media_id, y, x, r, g, b, a): point operations, histograms, tone, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.blend import COMPONENTS, blend
from ..functions.rounding import clamp, half_up

RGB = ("r", "g", "b")


def rgb_of(prefix: str = "") -> color.Rgb:
    return tuple(F.col(f"{prefix}{c}") for c in RGB)


def map_pixels(pixels: DataFrame, fn) -> DataFrame:
    """fn takes and gives the three colour columns; alpha and all other columns stay."""
    return pixels.withColumns(dict(zip(RGB, fn(rgb_of()), strict=True)))


def staged(pixels: DataFrame, into, back) -> DataFrame:
    """Colours through another space: into(rgb) gives its parts, back(parts) the colours; parts are computed once per pixel."""
    parts = into(rgb_of())
    names = [f"__part{i}" for i in range(len(parts))]
    return pixels.withColumns(dict(zip(names, parts, strict=True))).withColumns(dict(zip(RGB, back(*map(F.col, names)), strict=True))).drop(*names)


def saturate(pixels: DataFrame, amount: float) -> DataFrame:
    return staged(pixels, color.rgb_to_hsl, lambda h, s, light: color.hsl_to_rgb(h, clamp(s + amount, 0.0, 100.0), light))


def rotate_hue(pixels: DataFrame, degrees: float) -> DataFrame:
    return staged(pixels, color.rgb_to_hsl, lambda h, s, light: color.hsl_to_rgb((h + degrees + 360) % 360, s, light))


def adjust(pixels: DataFrame, brightness: float = 0, contrast: float = 0, saturation: float = 0, hue: float = 0, gamma: float = 1) -> DataFrame:
    """Brightness, contrast, saturation and hue, gamma, in this order; each step is rounded."""
    out = pixels
    for value, step in ((brightness, color.brightness), (contrast, color.contrast)):
        if value:
            out = map_pixels(out, lambda rgb, s=step, v=value: s(rgb, v))
    if saturation or hue:
        out = staged(out, color.rgb_to_hsl, lambda h, s, light: color.hsl_to_rgb((h + hue + 360) % 360, clamp(s + saturation, 0.0, 100.0), light))
    return map_pixels(out, lambda rgb: color.gamma(rgb, gamma)) if gamma != 1 else out


# --- histograms ---


def histogram(pixels: DataFrame) -> DataFrame:
    """media_id, channel, bin, freq (long): red, green, blue, alpha and luminance; a bin without pixels has no row."""
    lum = color.luminance709(*rgb_of())
    each = F.array(*[F.struct(F.lit(n).alias("channel"), c.cast("int").alias("bin")) for n, c in (("red", F.col("r")), ("green", F.col("g")), ("blue", F.col("b")), ("alpha", F.col("a")), ("luminance", lum))])
    return pixels.select("media_id", F.explode(each).alias("e")).groupBy("media_id", F.col("e.channel").alias("channel"), F.col("e.bin").alias("bin")).agg(F.count(F.lit(1)).alias("freq"))


def _running(hist: DataFrame) -> DataFrame:
    own = Window.partitionBy("media_id", "channel")
    return hist.withColumn("cum", F.sum("freq").over(own.orderBy("bin"))).withColumn("total", F.sum("freq").over(own))


def channel_stats(hist: DataFrame) -> DataFrame:
    """media_id, channel, min, max, mean, std (of the population), median (the first bin with half of the pixels)."""
    run = _running(hist)
    x, n = F.col("bin").cast("double"), F.sum("freq")
    mean = F.sum(x * F.col("freq")) / n
    return run.groupBy("media_id", "channel").agg(
        F.min("bin").alias("min"),
        F.max("bin").alias("max"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(x * x * F.col("freq")) / n - mean * mean, F.lit(0.0))).alias("std"),
        F.min(F.when(F.col("cum") >= F.col("total") / 2, F.col("bin"))).alias("median"),
    )


def percentile_bins(hist: DataFrame, **percents: float) -> DataFrame:
    """media_id, channel, and for each name=percent the first of the bins 0..255 with that share of the pixels (0 for 0)."""
    pick = [(F.lit(0) if p <= 0 else F.coalesce(F.min(F.when(F.col("cum") >= F.col("total") * p / 100, F.col("bin"))), F.lit(255))).cast("int").alias(n) for n, p in percents.items()]
    return _running(hist).groupBy("media_id", "channel").agg(F.max("total").alias("total"), *pick).drop("total")


def cumulative(hist: DataFrame) -> DataFrame:
    """media_id, channel, bin, cdf on the bins that have pixels."""
    return _running(hist).select("media_id", "channel", "bin", (F.col("cum") / F.col("total")).alias("cdf"))


def exposure(pixels: DataFrame, low_contrast: int = 50, under: float = 80, over: float = 180) -> DataFrame:
    """media_id, low_contrast, underexposed, overexposed."""
    lum = color.luminance709(*rgb_of())
    found = pixels.groupBy("media_id").agg((F.max(lum) - F.min(lum)).alias("span"), F.avg(lum).alias("mean"))
    return found.select("media_id", (F.col("span") < low_contrast).alias("low_contrast"), (F.col("mean") < under).alias("underexposed"), (F.col("mean") > over).alias("overexposed"))


def _stretched(v: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low, 128).when(v <= low, 0).when(v >= high, 255).otherwise(half_up((v - low).cast("double") / (high - low) * 255)).cast("int")


def auto_levels(pixels: DataFrame, shadow: float = 0.1, highlight: float = 0.1, per_channel: bool = False) -> DataFrame:
    """Stretches each image between percentiles of its luminance, or of each channel; images with one value become 128."""
    bounds = percentile_bins(histogram(pixels), low=shadow, high=100 - highlight)
    source = {c: n if per_channel else "luminance" for c, n in zip(RGB, ("red", "green", "blue"), strict=True)}
    wide = bounds.groupBy("media_id").agg(*[F.max(F.when(F.col("channel") == n, F.col(b))).alias(f"__{n}_{b}") for n in set(source.values()) for b in ("low", "high")])
    joined = pixels.join(wide, "media_id")
    return joined.withColumns({c: _stretched(F.col(c), F.col(f"__{n}_low"), F.col(f"__{n}_high")) for c, n in source.items()}).select(pixels.columns)


def auto_contrast(pixels: DataFrame, clip: float = 0.5) -> DataFrame:
    return auto_levels(pixels, clip, clip)


def normalize(pixels: DataFrame) -> DataFrame:
    return auto_levels(pixels, 0, 0, per_channel=True)


def equalize(pixels: DataFrame) -> DataFrame:
    """Equalises the luminance of each image and scales its colours by the change."""
    run = cumulative(histogram(pixels).where("channel = 'luminance'"))
    first = run.groupBy("media_id").agg(F.min("cdf").alias("least"))
    new = F.when(F.col("least") == 1, F.lit(0)).otherwise(half_up((F.col("cdf") - F.col("least")) / F.when(F.col("least") < 1, 1 - F.col("least")) * 255)).cast("int")
    luts = run.join(first, "media_id").groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin"), new))).alias("__lut"))  # 256 bins at most
    lum = color.luminance709(*rgb_of())
    joined = pixels.join(luts, "media_id").withColumn("__lum", lum).withColumn("__new", F.element_at("__lut", F.col("__lum").cast("int")))
    scaled = lambda c: F.when(F.col("__lum") == 0, F.col("__new")).otherwise(clamp(half_up(F.col(c) * (F.col("__new").cast("double") / F.when(F.col("__lum") != 0, F.col("__lum")))))).cast("int")
    return joined.withColumns({c: scaled(c) for c in RGB}).select(pixels.columns)


def match_histogram(pixels: DataFrame, reference: DataFrame) -> DataFrame:
    """Maps each channel to the bin of the reference image (one media_id) whose share is nearest, the smaller bin on ties.

    The reference's 256 bins for each channel are packed to arrays, a bounded side for the join.
    """
    bins = F.sequence(F.lit(0), F.lit(255))
    known = cumulative(histogram(reference)).groupBy("channel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "cdf")))).alias("at"))
    dense = known.select("channel", F.transform(bins, lambda b: F.coalesce(F.array_max(F.transform(F.filter(F.map_entries("at"), lambda e: e["key"] <= b), lambda e: e["value"])), F.lit(0.0))).alias("cdfs"))
    lut = cumulative(histogram(pixels)).join(F.broadcast(dense), "channel")  # 5 rows
    nearest = F.array_min(F.transform("cdfs", lambda c, i: F.struct(F.abs(c - F.col("cdf")).alias("far"), i.alias("bin"))))["bin"]
    entry = F.struct("bin", nearest.cast("int").alias("to"))
    luts = lut.groupBy("media_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("channel") == n, entry))).alias(f"__{c}") for c, n in zip(RGB, ("red", "green", "blue"), strict=True)])  # three maps of 256 bins at most
    return pixels.join(luts, "media_id").withColumns({c: F.element_at(f"__{c}", F.col(c).cast("int")) for c in RGB}).select(pixels.columns)


# --- layers ---


def composite(base: DataFrame, overlay: DataFrame, x: int = 0, y: int = 0, mode: str = "normal", opacity: float = 1.0) -> DataFrame:
    """overlay, moved by (x, y), blended on base pixel by pixel of the same media_id; what lies outside of base is cut off."""
    from ..functions.color import d

    over = overlay.select("media_id", (F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), *[F.col(c).alias(f"__{c}") for c in (*RGB, "a")])
    both = base.join(over, ["media_id", "y", "x"], "left")
    if mode in COMPONENTS:
        hsl = [*color.hsl_unit(rgb_of()), *color.hsl_unit(rgb_of("__"))]
        both = both.withColumns({f"__p{i}": c for i, c in enumerate(hsl)})
        mixed = color.unit_to_rgb(*(F.col(f"__p{i + 3 * take}") for i, take in enumerate(COMPONENTS[mode])))
    else:
        mixed = blend(rgb_of(), rgb_of("__"), mode)
    share = F.coalesce(d(F.col("__a")) / 255 * opacity, F.lit(0.0))
    both = both.withColumns({"__share": share, **{f"__m{c}": m for c, m in zip(RGB, mixed, strict=True)}})
    colours = {c: F.when(F.col("__share") == 0, F.col(c)).otherwise(half_up(d(F.col(c)) * (1 - F.col("__share")) + F.col(f"__m{c}") * F.col("__share"))).cast("int") for c in RGB}
    alpha = F.when(F.col("__share") == 0, F.col("a")).otherwise(F.greatest(F.col("a"), half_up(d(F.col("__a")) * opacity))).cast("int")
    return both.withColumns({**colours, "a": alpha}).select(base.columns)


def flatten_layers(layers: DataFrame) -> DataFrame:
    """media_id, y, x, r, g, b, a from layers (media_id, z, y, x, r, g, b, a, opacity, visible): Porter-Duff over in the order of z."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in (*RGB, "a")])

    def over(below: Column, layer: Column) -> Column:
        share = layer["a"] / 255 * layer["opacity"]
        out = share + below["a"] / 255 * (1 - share)
        mix = lambda c: half_up((layer[c] * share + below[c] * (below["a"] / 255) * (1 - share)) / out).cast("double")
        over_nothing = F.struct(*[layer[c].alias(c) for c in RGB], half_up(share * 255).cast("double").alias("a"))
        return F.when(share == 0, below).when(below["a"] == 0, over_nothing).otherwise(F.struct(*[mix(c).alias(c) for c in RGB], half_up(out * 255).cast("double").alias("a")))

    stacked = layers.where("visible").groupBy("media_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct("z", *[F.col(c).cast("double").alias(c) for c in (*RGB, "a", "opacity")]))).alias("stack"))
    return stacked.select("media_id", "y", "x", F.aggregate("stack", zero, over).alias("o")).select("media_id", "y", "x", *[F.col(f"o.{c}").cast("int").alias(c) for c in (*RGB, "a")])


def apply_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Alpha times the mask's luma; beyond the mask its last row and column count. Each media_id has its own mask."""
    gray = mask.select("media_id", F.col("y").alias("__y"), F.col("x").alias("__x"), color.luma601(*rgb_of()).alias("__luma"))
    size = mask.groupBy("media_id").agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    placed = pixels.join(size, "media_id").withColumns({"__y": F.least("y", "__h"), "__x": F.least("x", "__w")})
    return placed.join(gray, ["media_id", "__y", "__x"]).withColumn("a", half_up(F.col("a") * F.col("__luma") / 255).cast("int")).select(pixels.columns)
