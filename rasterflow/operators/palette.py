"""Palettes of images by median cut, and images as indices into them.

Spark gathers the distinct colours of each image, at most 2 ** 24; one task cuts those of one image, as arrays.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours whose distances to a palette are held at once.
BLOCK = 1 << 14


def _colour() -> Column:
    return F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b")).cast("int")


def _mean(rgb: np.ndarray) -> np.ndarray:
    """The channels' means, halves rounded up."""
    return (2 * rgb.sum(axis=0) + len(rgb)) // (2 * len(rgb))


def cut(rgb: np.ndarray, size: int) -> np.ndarray:
    """The palette of the distinct colours rgb: themselves if they are size or fewer, else the means of size boxes.

    Again and again the box of the longest side is halved, the leftmost of such; it is sorted along that side, red before
    green before blue, and equal values keep their order.
    """
    if len(rgb) <= size:
        return rgb

    def opened(path: str, own: np.ndarray) -> tuple | None:
        sides = np.ptp(rgb[own], axis=0)
        # The first of the longest sides; boxes of one colour are not cut. A path sorts as the box lies from left to right.
        return (-int(sides.max()), path, int(sides.argmax()), own) if sides.max() else None

    root = np.arange(len(rgb))
    done: dict[str, np.ndarray] = {}
    todo = [opened("", root)]
    while todo and len(todo) + len(done) < size:
        _, path, axis, own = heapq.heappop(todo)
        own = own[np.argsort(rgb[own, axis], kind="stable")]
        for side, half in (("0", own[: len(own) // 2]), ("1", own[len(own) // 2 :])):
            box = opened(path + side, half)
            if box:
                heapq.heappush(todo, box)
            else:
                done[path + side] = half
    done |= {path: own for _, path, _, own in todo}
    return np.stack([_mean(rgb[done[path]]) for path in sorted(done)])


def padded(palette: np.ndarray) -> np.ndarray:
    """The palette with black up to a power of two, two at least."""
    size = max(2, 1 << (len(palette) - 1).bit_length())
    return np.concatenate((palette, np.zeros((size - len(palette), 3), dtype=palette.dtype)))


def nearest(rgb: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The index of each colour: the last entry that equals it, else the first of the nearest ones."""
    code = lambda c: c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]
    last = {int(c): i for i, c in enumerate(code(palette))}
    out = np.array([last.get(int(c), -1) for c in code(rgb)], dtype=np.int64)
    open_ = np.flatnonzero(out < 0)
    for at in range(0, len(open_), BLOCK):
        own = open_[at : at + BLOCK]
        out[own] = ((rgb[own, None, :] - palette[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def distinct_colours(pixels: DataFrame) -> DataFrame:
    """media_id, colour (0xRRGGBB), first: the colours of each image, with where each is met first."""
    return pixels.select("media_id", _colour().alias("colour"), F.struct("y", "x").alias("at")).groupBy("media_id", "colour").agg(F.min("at").alias("first"))


def _cut_images(pixels: DataFrame, size: int, run, fields: tuple[tuple[str, str], ...]) -> DataFrame:
    schema = pixels.select("media_id").schema
    for name, kind in fields:
        schema = schema.add(name, kind)
    colours = distinct_colours(pixels).select("media_id", "colour", F.col("first.y").alias("y"), F.col("first.x").alias("x"))

    def image(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("y", "ascending"), ("x", "ascending")])
        code = rows["colour"].to_numpy().astype(np.int64)
        rgb = np.stack((code >> 16, code >> 8 & 255, code & 255), axis=1)
        found = run(code, rgb, padded(cut(rgb, size)))
        media = rows["media_id"].combine_chunks().take(pa.array(np.zeros(len(found[0]), dtype=np.int64)))
        return pa.table([media, *(pa.array(f, pa.int32()) for f in found)], names=["media_id", *(n for n, _ in fields)])

    return colours.groupBy("media_id").applyInArrow(image, schema)


def median_cut(pixels: DataFrame, size: int = 256) -> DataFrame:
    """media_id, index, r, g, b: the palette of each image of pixels (media_id, y, x, r, g, b), filled up with black to a power of two.

    An image of size colours or fewer has them all, in the order in which they are met row by row.
    """
    return _cut_images(pixels, size, lambda code, rgb, palette: (np.arange(len(palette)), *palette.T), (("index", "integer"), ("r", "integer"), ("g", "integer"), ("b", "integer")))


def indexed(pixels: DataFrame, size: int = 256) -> DataFrame:
    """media_id, y, x, index: the pixels as indices into the palette of their image."""
    known = _cut_images(pixels, size, lambda code, rgb, palette: (code, nearest(rgb, palette)), (("colour", "integer"), ("index", "integer")))
    return pixels.withColumn("colour", _colour()).join(known, ["media_id", "colour"]).select("media_id", "y", "x", "index")
