"""Shapes on long pixels (media_id, y, x, r, g, b, a).

A shape is a condition on x and y in closed form, so that painting is a projection: no shuffle, no generated points, no Python.
Only flood fill follows neighbours; it works on packed rasters, each within its row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import half_up

X, Y = "x", "y"
Colour = tuple[int | Column, int | Column, int | Column, int | Column]
Point = tuple[float, float]


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _round(v: float) -> int:
    return math.floor(v + 0.5)


def paint(pixels: DataFrame, inside: Column, colour: Colour) -> DataFrame:
    """Lays colour (r, g, b, a) on the pixels where inside holds: mixed by its alpha; the greater alpha stays."""
    *rgb, alpha = map(_c, colour)
    share = alpha.cast("double") / 255
    mixed = {c: F.when(inside, half_up(new * share + F.col(c) * (1 - share)).cast("int")).otherwise(F.col(c)) for c, new in zip("rgb", rgb, strict=True)}
    return pixels.withColumns({**mixed, "a": F.when(inside, F.greatest("a", alpha.cast("int"))).otherwise(F.col("a"))})


def rect(x: float, y: float, width: float, height: float) -> Column:
    return (F.col(X) >= math.floor(x)) & (F.col(X) < math.floor(x + width)) & (F.col(Y) >= math.floor(y)) & (F.col(Y) < math.floor(y + height))


def circle(cx: float, cy: float, radius: float) -> Column:
    """Centre and radius are rounded first."""
    dx, dy, r = F.col(X) - _round(cx), F.col(Y) - _round(cy), _round(radius)
    return dx * dx + dy * dy <= r * r


def ellipse(cx: int, cy: int, rx: int, ry: int) -> Column:
    dx, dy = F.col(X) - cx, F.col(Y) - cy
    return dx * dx / (rx * rx) + dy * dy / (ry * ry) <= 1


def _course(x0: float, y0: float, x1: float, y1: float) -> tuple[Column, Column, int, Callable[[Column], Column]]:
    """A pixel's place along the longer axis from the rounded start and across it, how far the line goes, and where it lies across at a place along."""
    x0, y0, x1, y1 = map(_round, (x0, y0, x1, y1))
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    along, across = (F.col(X) - x0) * (1 if x1 > x0 else -1), (F.col(Y) - y0) * (1 if y1 > y0 else -1)
    long, short = dx, dy
    if dy > dx:
        along, across, long, short = across, along, dy, dx
    return along, across, long, lambda at: F.floor((at * (2 * short) + (long - 1)) / (2 * long)) if long else F.lit(0)


def line(x0: float, y0: float, x1: float, y1: float) -> Column:
    """The pixels nearest to the line between the rounded ends, along the longer axis; halves go towards the start."""
    along, across, long, step = _course(x0, y0, x1, y1)
    return along.between(0, long) & (across == step(along))


def stamps(x0: float, y0: float, x1: float, y1: float, width: float) -> Column:
    """How many of the discs cover a pixel that lie around each pixel of line(); their radius is half the width, rounded."""
    along, across, long, step = _course(x0, y0, x1, y1)
    radius = _round(width / 2)
    near = lambda o: ((along + o).between(0, long) & ((across - step(along + o)) * (across - step(along + o)) <= radius * radius - o * o)).cast("int")
    return sum((near(o) for o in range(-radius + 1, radius + 1)), near(-radius))


def lay(pixels: DataFrame, times: Column, colour: Colour) -> DataFrame:
    """Lays colour (r, g, b, a) on each pixel as many times as times says, rounding each time as paint() does."""
    *rgb, alpha = map(_c, colour)
    share = alpha.cast("double") / 255
    n = spare_name(pixels, "times")
    again = F.sequence(F.lit(1), F.col(n))
    laid = lambda c, new: F.when(F.col(n) > 0, F.aggregate(again, F.col(c).cast("int"), lambda below, _: half_up(new * share + below * (1 - share)).cast("int"))).otherwise(F.col(c))
    counted = pixels.withColumn(n, times.cast("int"))
    return counted.withColumns({**{c: laid(c, new) for c, new in zip("rgb", rgb, strict=True)}, "a": F.when(F.col(n) > 0, F.greatest("a", alpha.cast("int"))).otherwise(F.col("a"))}).drop(n)


def spare_name(df: DataFrame, word: str) -> str:
    """A name that no column has."""
    while word in df.columns:
        word += "_"
    return word


def draw_line(pixels: DataFrame, x0: float, y0: float, x1: float, y1: float, colour: Colour, width: float = 1) -> DataFrame:
    """A line of a width: discs along it, so a translucent colour is laid on again wherever they overlap."""
    return paint(pixels, line(x0, y0, x1, y1), colour) if width == 1 else lay(pixels, stamps(x0, y0, x1, y1, width), colour)


def ellipse_steps(rx: int, ry: int) -> tuple[list[int], list[int]]:
    """The outline in the first quadrant by the midpoint rule: the row of each column where it is flat, and the column of each row where it is steep.

    The rule asks on which side of the ellipse the middle between two next pixels lies, with the first middle of each part
    rounded to a whole number and the others off by as much.
    """
    outside = lambda x, y: (ry * x) ** 2 + (rx * y) ** 2 - (rx * ry) ** 2
    drift = lambda v: _round(v) - v
    rows, y = [], ry
    off = drift(outside(1, ry - 0.5))
    while ry * ry * len(rows) < rx * rx * y:
        rows.append(y)
        y -= outside(len(rows), y - 0.5) + off >= 0
    columns: dict[int, int] = {}
    x = len(rows)
    off = drift(outside(x + 0.5, y - 1))
    while y >= 0:
        columns[y] = x
        y -= 1
        x += outside(x + 0.5, y) + off <= 0
    return rows, [columns[k] for k in range(len(columns))]


def draw_ellipse(pixels: DataFrame, cx: float, cy: float, rx: int, ry: int, colour: Colour, fill: Colour | None = None) -> DataFrame:
    """The outline of an ellipse, laid on once for each quadrant, so more than once on its axes; and the ellipse a pixel within it, filled."""
    rows, columns = ellipse_steps(rx, ry)
    dx, dy = F.abs(F.col(X) - _round(cx)), F.abs(F.col(Y) - _round(cy))
    on = lambda steps, at, value: F.coalesce(F.try_element_at(F.array(*map(F.lit, steps)), (at + 1).cast("int")) == value, F.lit(False)).cast("int") if steps else F.lit(0)
    times = (on(rows, dx, dy) + on(columns, dy, dx)) * F.when(dx == 0, 2).otherwise(1) * F.when(dy == 0, 2).otherwise(1)
    drawn = lay(pixels, times, colour)
    return drawn if fill is None or min(rx, ry) < 2 else paint(drawn, ellipse(_round(cx), _round(cy), rx - 1, ry - 1), fill)


def polygon(points: list[Point]) -> Column:
    """Even-odd rule, with both ends of each span: a pixel is inside if an odd number of edges cross its row to its left, or one at it."""
    if len(points) < 3:
        return F.lit(False)
    y, left, at = F.col(Y), [], []
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1], strict=True):
        if ya != yb:
            crosses = (y >= min(ya, yb)) & (y < max(ya, yb))
            where = F.lit(float(xa)) + (y - float(ya)) / (yb - ya) * (xb - xa)
            left.append((crosses & (where < F.col(X))).cast("int"))
            at.append(crosses & (where == F.col(X)))
    if not left:
        return F.lit(False)
    on = at[0]
    for other in at[1:]:
        on = on | other
    return on | (sum(left) % 2 == 1)


def outline(pixels: DataFrame, points: list[Point], colour: Colour) -> DataFrame:
    """The closed line through points; where sides meet, a translucent colour is laid on twice."""
    for a, b in zip(points, points[1:] + points[:1], strict=True):
        pixels = paint(pixels, line(*a, *b), colour)
    return pixels


def circle_steps(radius: int) -> list[int]:
    """For each row from the centre on the column of the outline, as far as the diagonal: a step inwards where (y + 1)^2 + x^2 - 1 exceeds the square of the radius."""
    xs = [radius]
    while True:
        y, x = len(xs), xs[-1]
        x -= (y + 1) * (y + 1) + x * x - 1 > radius * radius
        if x < y:
            return xs
        xs.append(x)


def draw_circle(pixels: DataFrame, cx: float, cy: float, radius: float, colour: Colour) -> DataFrame:
    """The outline of a circle. It is laid on once for each of eight mirrored arcs, so twice where two arcs meet."""
    steps = circle_steps(_round(radius))
    dx, dy, xs = F.abs(F.col(X) - _round(cx)), F.abs(F.col(Y) - _round(cy)), F.array(*map(F.lit, steps))
    on = lambda row, column: F.coalesce(F.try_element_at(xs, (row + 1).cast("int")) == column, F.lit(False)).cast("int")
    arcs = (on(dy, dx) + on(dx, dy)) * F.when(dx == 0, 2).otherwise(1) * F.when(dy == 0, 2).otherwise(1)
    marked = pixels.withColumn("__arcs", arcs)
    for k in range(1, 9 if steps == [0] else 3):
        marked = paint(marked, F.col("__arcs") >= k, colour)
    return marked.drop("__arcs")


def draw_rect(pixels: DataFrame, x: float, y: float, width: float, height: float, colour: Colour) -> DataFrame:
    right, bottom = x + width - 1, y + height - 1
    return outline(pixels, [(x, y), (right, y), (right, bottom), (x, bottom)], colour)


# --- gradients ---


def linear_position(x1: float, y1: float, x2: float, y2: float) -> Column:
    dx, dy = float(x2 - x1), float(y2 - y1)
    size = dx * dx + dy * dy
    return ((F.col(X) - x1) * dx + (F.col(Y) - y1) * dy) / size if size else F.lit(0.0)


def radial_position(cx: float, cy: float, radius: float) -> Column:
    dx, dy = F.col(X) - float(cx), F.col(Y) - float(cy)
    return F.sqrt(dx * dx + dy * dy) / float(radius)


def gradient_colour(t: Column, stops: list[tuple[float, tuple[int, int, int, int]]]) -> Colour:
    """The colour at t, clamped to 0..1, between the first pair of stops (position, colour) around it; no stops give opaque black."""
    if not stops:
        return 0, 0, 0, 255
    if len(stops) == 1:
        return stops[0][1]
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))

    def between(lower, upper, i: int) -> Column:
        span = upper[0] - lower[0]
        part = (t - float(lower[0])) / span if span else F.lit(0.0)
        return half_up(lower[1][i] + (upper[1][i] - lower[1][i]) * part)

    def of(i: int) -> Column:
        chosen = None
        for lower, upper in zip(stops, stops[1:], strict=False):
            here = (t >= lower[0]) & (t <= upper[0])
            chosen = (F if chosen is None else chosen).when(here, between(lower, upper, i))
        return chosen.otherwise(between(stops[0], stops[-1], i)).cast("int")

    return tuple(of(i) for i in range(4))


def fill_gradient(pixels: DataFrame, position: Column, stops: list) -> DataFrame:
    return paint(pixels, F.lit(True), gradient_colour(position, stops))


# --- palettes and fills ---


def nearest_colour(rgb: tuple[Column, Column, Column], palette: list[tuple[int, int, int]]) -> Column:
    """The index, from 0, of the palette colour with the least squared distance, the first on ties."""
    far = [sum((c - p) * (c - p) for c, p in zip(rgb, colour, strict=True)) for colour in palette]
    return F.array_min(F.array(*[F.struct(d.alias("far"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"]


def flood_mask(rasters: DataFrame, x: int, y: int, channels: tuple[str, ...] = ("r", "g", "b", "a"), tolerance: int = 0) -> DataFrame:
    """media_id, width, height, the channels and mask (array<int> of 0 and 1): what four-way steps reach from (x, y) over pixels within tolerance of it in each channel."""
    columns = ["media_id", "width", "height", *channels]

    def reach(w: int, h: int, planes: list[np.ndarray]) -> np.ndarray:
        found = np.zeros((h, w), dtype=bool)
        if not (0 <= x < w and 0 <= y < h):
            return found
        like = np.logical_and.reduce([np.abs(p.reshape(h, w).astype(np.int64) - int(p[y * w + x])) <= tolerance for p in planes])
        found[y, x] = True
        edge = found.copy()
        while edge.any():
            near = np.zeros_like(found)
            near[1:] |= edge[:-1]
            near[:-1] |= edge[1:]
            near[:, 1:] |= edge[:, :-1]
            near[:, :-1] |= edge[:, 1:]
            edge = near & like & ~found
            found |= edge
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            masks = [reach(w, h, [c[i].values.to_numpy(zero_copy_only=False) for c in b.columns[3:]]).reshape(-1).astype(np.int32) for i, (w, h) in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(masks, pa.list_(pa.int32()))], [*columns, "mask"])

    schema = rasters.select(*columns).schema.add("mask", T.ArrayType(T.IntegerType()))
    return rasters.select(*columns).mapInArrow(run, schema)


# --- whole canvases ---


def create_image(ids: DataFrame, width: int, height: int, colour: Colour = (0, 0, 0, 0)) -> DataFrame:
    """Long pixels of one colour for each media_id of ids."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))) if width * height > 0 else F.explode(F.array().cast("array<int>"))
    each = ids.select("media_id", cells.alias("i"))
    return each.select("media_id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), *[_c(v).alias(c) for c, v in zip("rgba", colour, strict=True)])


def clear(pixels: DataFrame, colour: Colour = (0, 0, 0, 0)) -> DataFrame:
    return pixels.withColumns({c: _c(v) for c, v in zip("rgba", colour, strict=True)})


def get_pixel(pixels: DataFrame, x: int, y: int) -> DataFrame:
    """media_id, r, g, b, a of that place; images without it give no row."""
    return pixels.where((F.col(X) == x) & (F.col(Y) == y)).select("media_id", *"rgba")


def set_pixel(pixels: DataFrame, x: float, y: float, colour: Colour) -> DataFrame:
    """Lays colour on the rounded place."""
    return paint(pixels, (F.col(X) == _round(x)) & (F.col(Y) == _round(y)), colour)
