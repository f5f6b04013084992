"""Geometry and filters on packed rasters: one row for each image, a channel is an array<int> in row order.

All are projections of the row: no shuffle, no Python. Lambdas over a row's cells are interpreted, not compiled, so what is
the same for many cells is made once (_let). Width and height are columns or numbers. pack() and unpack() change between
packed rasters and long pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import channel, clamp, half_up

Size = Column | int


def _c(v: Size) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _cell(data: Column, w: Column, x: Column, y: Column) -> Column:
    return F.element_at(data, (y * w + x + 1).cast("int"))


def _grid(w: Column, h: Column, fn) -> Column:
    """fn(x, y) of every cell of a w by h raster; an empty raster gives an empty array."""
    cells = F.transform(F.sequence(F.lit(0), F.greatest(w * h - 1, F.lit(0)).cast("int")), lambda i: fn((i % w).cast("int"), F.floor(i / w).cast("int")))
    return F.when(w * h > 0, cells).otherwise(F.array().cast("array<int>"))


def pack(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """media_id, width, height and an array for each channel, from long pixels without holes."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *channels)))
    grouped = pixels.groupBy("media_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), cells.alias("__cells"))
    return grouped.select("media_id", "width", "height", *[F.col(f"__cells.{c}").alias(c) for c in channels])


def unpack(rasters: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """media_id, y, x and the channels, one row for each pixel."""
    cells = rasters.select("media_id", "width", F.posexplode(F.arrays_zip(*channels)).alias("__i", "__p"))
    return cells.select("media_id", F.floor(F.col("__i") / F.col("width")).cast("int").alias("y"), (F.col("__i") % F.col("width")).cast("int").alias("x"), *[F.col(f"__p.{c}").alias(c) for c in channels])


# --- geometry: each takes a channel and its size and gives the new channel ---


def flip_horizontal(data: Column, w: Size, h: Size) -> Column:
    w, h = _c(w), _c(h)
    return _grid(w, h, lambda x, y: _cell(data, w, w - 1 - x, y))


def flip_vertical(data: Column, w: Size, h: Size) -> Column:
    w, h = _c(w), _c(h)
    return _grid(w, h, lambda x, y: _cell(data, w, x, h - 1 - y))


def flip_both(data: Column, w: Size, h: Size) -> Column:
    return F.reverse(data)


rotate_180 = flip_both


def rotate_90(data: Column, w: Size, h: Size) -> Column:
    """Clockwise; the new raster is h wide and w high."""
    w, h = _c(w), _c(h)
    return _grid(h, w, lambda x, y: _cell(data, w, y, h - 1 - x))


def rotate_270(data: Column, w: Size, h: Size) -> Column:
    w, h = _c(w), _c(h)
    return _grid(h, w, lambda x, y: _cell(data, w, w - 1 - y, x))


def crop(data: Column, w: Size, h: Size, x: Size, y: Size, width: Size, height: Size) -> Column:
    w, h, x, y, width, height = map(_c, (w, h, x, y, width, height))
    ok = (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= w) & (y + height <= h)
    return F.when(ok, _grid(width, height, lambda i, j: _cell(data, w, x + i, y + j))).otherwise(F.raise_error(F.lit("crop outside of the image")).cast("array<int>"))


def extend(data: Column, w: Size, h: Size, top: int = 0, right: int = 0, bottom: int = 0, left: int = 0, fill: int = 0) -> Column:
    w, h = _c(w), _c(h)
    inside = lambda x, y: (x >= left) & (x < w + left) & (y >= top) & (y < h + top)
    return _grid(w + left + right, h + top + bottom, lambda x, y: F.when(inside(x, y), _cell(data, w, x - left, y - top)).otherwise(fill))


def auto_crop_box(rasters: DataFrame, channels: tuple[str, ...], tolerance: int = 0) -> DataFrame:
    """media_id, x, y, width, height of the pixels that differ from the first one by more than tolerance in sum; 0 by 0 if none does."""
    long = unpack(rasters, channels)
    first = rasters.select("media_id", *[F.element_at(c, 1).alias(f"__{c}") for c in channels])
    far = sum(F.abs(F.col(c) - F.col(f"__{c}")) for c in channels)
    box = long.join(first, "media_id").where(far > tolerance).groupBy("media_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    return rasters.select("media_id").join(box, "media_id", "left").fillna(0)


def resize_nearest(data: Column, w: Size, h: Size, new_w: int, new_h: int) -> Column:
    w, h = _c(w), _c(h)
    return _grid(F.lit(new_w), F.lit(new_h), lambda x, y: _cell(data, w, F.floor(x * (w / new_w)), F.floor(y * (h / new_h))))


def _let(values: dict[str, Column], body) -> Column:
    """body of a struct of values, each of which is computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def _axis(n: Column, new_n: int, reach: range, weight) -> Column:
    """For each of new_n places along an axis of n cells: the cells that it takes (kept inside), their weights and the weights' sum."""

    def at(i: Column) -> Column:
        place = i * (n / new_n)
        first = F.floor(place)
        weights = [weight(place - first - k) for k in reach]
        return F.struct(F.array(*[clamp(first + k, 0, n - 1) for k in reach]).alias("cells"), F.array(*weights).alias("weights"), sum(weights).alias("total"))

    return F.transform(F.sequence(F.lit(0), F.lit(new_n - 1)), at)


def _resampled(data: Column, w: Column, h: Column, new_w: int, new_h: int, reach: range, weight, normalise: bool) -> Column:
    """Two separable passes: all rows to the new width, then the new rows. The weights are made once for each axis."""
    taps = range(len(reach))

    def columns(s: Column) -> Column:
        def cell(k: Column) -> Column:
            x, start = s["across"][(k % new_w).cast("int")], F.floor(k / new_w) * w
            return sum(F.element_at(data, (start + x["cells"][i] + 1).cast("int")) * x["weights"][i] for i in taps)

        return F.transform(F.sequence(F.lit(0), h.cast("int") * new_w - 1), cell)

    def rows(s: Column) -> Column:
        def cell(x: Column, y: Column) -> Column:
            across, down = s["across"][x], s["down"][y]
            total = sum(F.element_at(s["lines"], (down["cells"][j] * new_w + x + 1).cast("int")) * down["weights"][j] for j in taps)
            return channel(total / (across["total"] * down["total"]) if normalise else total)

        return _grid(F.lit(new_w), F.lit(new_h), cell)

    axes = {"across": _axis(w, new_w, reach, weight), "down": _axis(h, new_h, reach, weight)}
    return _let(axes, lambda s: _let({"across": s["across"], "down": s["down"], "lines": columns(s)}, rows))


def cubic_weight(x: Column) -> Column:
    t = F.abs(x)
    return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(F.lit(0.0))


def lanczos_weight(x: Column, a: int = 3) -> Column:
    px = F.lit(math.pi) * x
    return F.when(x == 0, F.lit(1.0)).when(F.abs(x) >= a, F.lit(0.0)).otherwise(a * F.sin(px) * F.sin(px / a) / F.when(x != 0, px * px))


def resize_bilinear(data: Column, w: Size, h: Size, new_w: int, new_h: int) -> Column:
    return _resampled(data, _c(w), _c(h), new_w, new_h, range(2), lambda t: 1 - F.abs(t), False)


def resize_bicubic(data: Column, w: Size, h: Size, new_w: int, new_h: int) -> Column:
    return _resampled(data, _c(w), _c(h), new_w, new_h, range(-1, 3), cubic_weight, False)


def resize_lanczos(data: Column, w: Size, h: Size, new_w: int, new_h: int) -> Column:
    return _resampled(data, _c(w), _c(h), new_w, new_h, range(-2, 4), lanczos_weight, True)


def fit_size(w: Size, h: Size, box_w: Size, box_h: Size, fit: str = "contain") -> tuple[Column, Column]:
    """The size of a w by h image in a box: fill, contain, cover, inside (never larger), outside (never smaller)."""
    w, h, box_w, box_h = (_c(v).cast("double") for v in (w, h, box_w, box_h))
    if fit == "fill":
        return box_w.cast("int"), box_h.cast("int")
    scale = F.least(box_w / w, box_h / h) if fit in ("contain", "inside") else F.greatest(box_w / w, box_h / h)
    scale = F.least(scale, F.lit(1.0)) if fit == "inside" else F.greatest(scale, F.lit(1.0)) if fit == "outside" else scale
    return half_up(w * scale).cast("int"), half_up(h * scale).cast("int")


def rotate(data: Column, w: int, h: int, degrees: float, fill: int = 0, expand: bool = True) -> tuple[Column, int, int]:
    """The rotated channel and its size; bilinear inside, fill where the source has no four neighbours."""
    angle = math.radians(degrees)
    cos, sin = math.cos(angle), math.sin(angle)
    new_w = math.ceil(abs(w * cos) + abs(h * sin)) if expand else w
    new_h = math.ceil(abs(w * sin) + abs(h * cos)) if expand else h

    def at(x: Column, y: Column) -> Column:
        dx, dy = x - new_w / 2, y - new_h / 2
        sx, sy = dx * cos + dy * sin + w / 2, dx * -sin + dy * cos + h / 2
        x0, y0 = F.floor(sx), F.floor(sy)
        fx, fy = sx - x0, sy - y0
        near = lambda i, j: _cell(data, F.lit(w), clamp(x0 + i, 0, w - 1), clamp(y0 + j, 0, h - 1))
        between = lambda a, b, t: a * (1 - t) + b * t
        value = between(between(near(0, 0), near(1, 0), fx), between(near(0, 1), near(1, 1), fx), fy)
        return F.when((sx >= 0) & (sx < w - 1) & (sy >= 0) & (sy < h - 1), half_up(value).cast("int")).otherwise(fill)

    return _grid(F.lit(new_w), F.lit(new_h), at), new_w, new_h


# --- filters ---

EDGES = ("clamp", "wrap", "mirror", "zero")


def _edge(v: Column, n: Column, mode: str) -> Column:
    if mode == "wrap":
        return F.pmod(v, n)
    if mode == "mirror":
        v = F.when(v < 0, -v - 1).when(v >= n, 2 * n - v - 1).otherwise(v)
    return clamp(v, 0, n - 1)


def _neighbour(data: Column, w: Column, h: Column, x: Column, y: Column, mode: str) -> Column:
    """Mode zero takes the first pixel for all that lie outside, as the compatible behaviour."""
    if mode == "zero":
        return F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), _cell(data, w, clamp(x, 0, w - 1), clamp(y, 0, h - 1))).otherwise(F.element_at(data, 1))
    return _cell(data, w, _edge(x, w, mode), _edge(y, h, mode))


def convolve(data: Column, w: Size, h: Size, kernel: list[list[float]], divisor: float | None = None, offset: float = 0, edge: str = "clamp") -> Column:
    """Correlation with the kernel; the divisor is the kernel's sum, or 1 if that is 0."""
    w, h = _c(w), _c(h)
    divisor = divisor if divisor is not None else sum(map(sum, kernel)) or 1
    cy, cx = len(kernel) // 2, len(kernel[0]) // 2
    taps = [(j - cy, i - cx, float(v)) for j, row in enumerate(kernel) for i, v in enumerate(row) if v]
    return _grid(w, h, lambda x, y: channel(sum(_neighbour(data, w, h, x + i, y + j, edge) * v for j, i, v in taps) / divisor + offset))


def convolve_separable(data: Column, w: Size, h: Size, kernel: list[float], edge: str = "clamp") -> Column:
    """Rows, then columns, rounded between. Nested in one expression: use it once for each step of a plan."""
    return convolve(convolve(data, w, h, [kernel], edge=edge), w, h, [[v] for v in kernel], edge=edge)


def gaussian_kernel(radius: int, sigma: float | None = None) -> list[float]:
    sigma = sigma or radius / 3
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


# The edge kernels.
SOBEL = ([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
PREWITT = ([[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]], [[-1, -1, -1], [0, 0, 0], [1, 1, 1]])
LAPLACIAN = [[0, -1, 0], [-1, 4, -1], [0, -1, 0]]
EMBOSS_RIGHT = [[-2, -1, 0], [-1, 1, 1], [0, 1, 2]]
EMBOSS_LEFT = [[0, -1, -2], [1, 1, -1], [2, 1, 0]]


def emboss_kernel(angle: float = 135, strength: float = 1) -> list[list[int]]:
    """Chosen by the sign of the rounded direction; upward ones are turned by half a circle."""
    dx, dy = (math.floor(f(math.radians(angle)) * strength + 0.5) for f in (math.cos, math.sin))
    kernel = EMBOSS_LEFT if dx < 0 else EMBOSS_RIGHT
    return [row[::-1] for row in kernel[::-1]] if dy < 0 else kernel


def blur(rasters: DataFrame, channels: tuple[str, ...], kernel: list[float], edge: str = "clamp") -> DataFrame:
    """Separable blur of channels, one step of the plan for each direction."""
    w, h = F.col("width"), F.col("height")
    rows = rasters.withColumns({c: convolve(F.col(c), w, h, [kernel], 1.0, edge=edge) for c in channels})
    return rows.withColumns({c: convolve(F.col(c), w, h, [[v] for v in kernel], 1.0, edge=edge) for c in channels})


def gaussian_blur(rasters: DataFrame, channels: tuple[str, ...], radius: int = 1) -> DataFrame:
    return blur(rasters, channels, gaussian_kernel(radius))


def box_blur(rasters: DataFrame, channels: tuple[str, ...], radius: int = 1) -> DataFrame:
    n = 2 * radius + 1
    w, h = F.col("width"), F.col("height")
    rows = rasters.withColumns({c: convolve(F.col(c), w, h, [[1.0] * n]) for c in channels})
    return rows.withColumns({c: convolve(F.col(c), w, h, [[1.0]] * n) for c in channels})


def sharpen(rasters: DataFrame, channels: tuple[str, ...], amount: float = 100, radius: int = 1) -> DataFrame:
    """Unsharp mask."""
    soft = gaussian_blur(rasters.withColumns({f"__{c}": F.col(c) for c in channels}), tuple(f"__{c}" for c in channels), radius)
    return soft.withColumns({c: F.zip_with(c, f"__{c}", lambda v, s: channel(v + amount / 100 * (v - s))) for c in channels}).drop(*[f"__{c}" for c in channels])


def gradient_edges(rasters: DataFrame, channel_name: str, kernels: tuple) -> DataFrame:
    """sqrt((gx - 128)^2 + (gy - 128)^2) of the two clamped convolutions without offset: a flat image becomes 181, as the compatible behaviour."""
    w, h, data = F.col("width"), F.col("height"), F.col(channel_name)
    both = rasters.withColumns({"__gx": convolve(data, w, h, kernels[0], 1), "__gy": convolve(data, w, h, kernels[1], 1)})
    return both.withColumn(channel_name, F.zip_with("__gx", "__gy", lambda a, b: channel(F.sqrt(((a - 128) * (a - 128) + (b - 128) * (b - 128)).cast("double"))))).drop("__gx", "__gy")


def laplacian(data: Column, w: Size, h: Size) -> Column:
    return convolve(data, w, h, LAPLACIAN, 1, 128)


def median(data: Column, w: Size, h: Size, radius: int = 1) -> Column:
    w, h = _c(w), _c(h)
    near = [(j, i) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)]
    return _grid(w, h, lambda x, y: F.element_at(F.array_sort(F.array(*[_neighbour(data, w, h, x + i, y + j, "clamp") for j, i in near])), len(near) // 2 + 1))


def bilateral(data: Column, w: Size, h: Size, radius: int = 1, range_sigma: float = 30.0, channels: int = 3) -> Column:
    """For gray rasters whose channels are equal; the colour distance counts each channel."""
    w, h = _c(w), _c(h)
    spatial = radius / 2

    def at(x: Column, y: Column) -> Column:
        here, num, den = _cell(data, w, x, y), [], []
        for j in range(-radius, radius + 1):
            for i in range(-radius, radius + 1):
                v = _neighbour(data, w, h, x + i, y + j, "clamp").cast("double")
                weight = math.exp(-(i * i + j * j) / (2 * spatial * spatial)) * F.exp(-(channels * (v - here) * (v - here)) / (2 * range_sigma * range_sigma))
                num.append(v * weight)
                den.append(weight)
        return half_up(sum(num) / sum(den)).cast("int")

    return _grid(w, h, at)


def bilateral_colour(rasters: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), radius: int = 1, range_sigma: float = 30.0) -> DataFrame:
    """Every channel smoothed by the weights of place and of the distance of all channels."""
    w, h = F.col("width"), F.col("height")
    spatial = radius / 2

    def at(x: Column, y: Column) -> Column:
        here, near = [_cell(F.col(c), w, x, y).cast("double") for c in channels], []
        for j in range(-radius, radius + 1):
            for i in range(-radius, radius + 1):
                v = [_neighbour(F.col(c), w, h, x + i, y + j, "clamp").cast("double") for c in channels]
                apart = sum((a - b) * (a - b) for a, b in zip(v, here, strict=True))
                weight = math.exp(-(i * i + j * j) / (2 * spatial * spatial)) * F.exp(-apart / (2 * range_sigma * range_sigma))
                near.append(F.struct(weight.alias("w"), *[a.alias(c) for a, c in zip(v, channels, strict=True)]))
        total = lambda s, c: F.aggregate(s["near"], F.lit(0.0), lambda t, n: t + n["w"] * (n[c] if c else F.lit(1.0)))
        mean = lambda s, c: half_up(total(s, c) / total(s, None)).cast("int").alias(c)
        return _let({"near": F.array(*near)}, lambda s: F.struct(*[mean(s, c) for c in channels]))

    cells = F.transform(F.sequence(F.lit(0), F.greatest(w * h - 1, F.lit(0)).cast("int")), lambda i: at((i % w).cast("int"), F.floor(i / w).cast("int")))
    return rasters.withColumn("__cells", cells).withColumns({c: F.when(w * h > 0, F.col(f"__cells.{c}")).otherwise(F.array().cast("array<int>")) for c in channels}).drop("__cells")


def denoise(rasters: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), algorithm: str = "median", radius: int = 1) -> DataFrame:
    """By the median of each channel, or bilateral."""
    if algorithm == "bilateral":
        return bilateral_colour(rasters, channels, radius)
    return rasters.withColumns({c: median(F.col(c), F.col("width"), F.col("height"), radius) for c in channels})


#: Where red lies in the two by two mosaics: column and row.
PHASES = {"RGGB": (0, 0), "GRBG": (1, 0), "GBRG": (0, 1), "BGGR": (1, 1)}


def demosaic(data: Column, w: Size, h: Size, bits: int = 8, phase: str = "RGGB") -> tuple[Column, Column, Column]:
    """Red, green and blue of a mosaic of raw samples of so many bits, as 8-bit channels.

    A sample is its own colour where it lies; green is else the rounded mean of the neighbours at its sides, red and blue that
    of those at its corners, as far as they lie in the picture, and 0 without any. (At green samples the corners are green:
    red and blue take those, as the raw decoder does whose results these match.)
    """
    w, h = _c(w), _c(h)
    left, top = PHASES[phase]
    sides, corners = ((-1, 0), (1, 0), (0, -1), (0, 1)), ((-1, -1), (1, -1), (-1, 1), (1, 1))

    def mean(x: Column, y: Column, ring: tuple) -> Column:
        inside = [(x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h) for dx, dy in ring]
        n = sum((i.cast("int") for i in inside[1:]), inside[0].cast("int"))
        total = sum((F.when(i, _cell(data, w, x + dx, y + dy)).otherwise(0) for i, (dx, dy) in zip(inside[1:], ring[1:], strict=True)), F.when(inside[0], _cell(data, w, x + ring[0][0], y + ring[0][1])).otherwise(0))
        return F.when(n > 0, half_up(total / n)).otherwise(0)

    def of(own, ring: tuple) -> Column:
        return _grid(w, h, lambda x, y: channel(F.when(own(x, y), _cell(data, w, x, y)).otherwise(mean(x, y, ring)) / (2**bits - 1) * 255))

    red = lambda x, y: (x % 2 == left) & (y % 2 == top)
    blue = lambda x, y: (x % 2 != left) & (y % 2 != top)
    green = lambda x, y: (x + y) % 2 != (left + top) % 2
    return of(red, corners), of(green, sides), of(blue, corners)
