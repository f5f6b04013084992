"""Raw video frames in planes: luma for each pixel, chroma for each pixel, each two in a row, or each square of four."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import samples as sm
from ..functions.rounding import half_up

#: Pixels across and down that share their chroma.
SHARED = {"444": (1, 1), "422": (2, 1), "420": (2, 2)}
Y, U, V = 0, 1, 2


def _cell(layout: str) -> tuple[Column, Column]:
    across, down = SHARED[layout]
    return F.floor(F.col("y") / down).cast("int"), F.floor(F.col("x") / across).cast("int")


def to_planes(pixels: DataFrame, layout: str = "420") -> DataFrame:
    """media_id, plane (0 luma, 1 and 2 chroma), y, x, value from pixels (media_id, y, x, r, g, b), in limited range.

    A chroma sample is the mean of those of the pixels that share it, rounded; at odd sides fewer pixels share one.
    """
    luma, u, v = sm.rgb_to_yuv(*(F.col(c) for c in "rgb"))
    coded = pixels.select("media_id", "y", "x", luma.alias("luma"), u.alias("u"), v.alias("v"))
    cy, cx = _cell(layout)
    mean = lambda c: half_up(F.sum(c) / F.count(F.lit(1))).cast("int")
    chroma = coded.groupBy("media_id", cy.alias("y"), cx.alias("x")).agg(mean("u").alias("u"), mean("v").alias("v"))
    planes = F.inline(F.array(F.struct(F.lit(U).alias("plane"), F.col("u").alias("value")), F.struct(F.lit(V).alias("plane"), F.col("v").alias("value"))))
    return coded.select("media_id", F.lit(Y).alias("plane"), "y", "x", F.col("luma").alias("value")).unionByName(chroma.select("media_id", "y", "x", planes))


def to_pixels(planes: DataFrame, layout: str = "420") -> DataFrame:
    """media_id, y, x, r, g, b from planes, in limited range: each pixel takes the chroma sample that it shares; one without has none, and no colour."""
    cy, cx = _cell(layout)
    luma = planes.where(F.col("plane") == Y).select("media_id", "y", "x", F.col("value").alias("luma"), cy.alias("cy"), cx.alias("cx"))
    of = lambda plane: F.max(F.when(F.col("plane") == plane, F.col("value")))
    chroma = planes.where(F.col("plane") != Y).groupBy("media_id", F.col("y").alias("cy"), F.col("x").alias("cx")).agg(of(U).alias("u"), of(V).alias("v"))
    both = luma.join(chroma, ["media_id", "cy", "cx"], "left")
    return both.select("media_id", "y", "x", *[c.alias(n) for n, c in zip("rgb", sm.yuv_to_rgb(F.col("luma"), F.col("u"), F.col("v")), strict=True)])


def frame_bytes(planes: DataFrame) -> DataFrame:
    """media_id, content: the planes one after the other, row by row."""
    two = F.lpad(F.hex(F.col("value").cast("long")), 2, "0")
    rows = planes.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("plane", "y", "x", two.alias("two")))).alias("p"))
    return rows.select("media_id", F.unhex(F.array_join(F.transform("p", lambda p: p["two"]), "")).alias("content"))


def read_planes(media: DataFrame, layout: str = "420") -> DataFrame:
    """media_id, plane, y, x, value of raw frames (media_id, width, height, content); what a short file lacks has no row."""
    across, down = SHARED[layout]
    w, h = F.col("width"), F.col("height")
    cw, ch = F.ceil(w / across).cast("int"), F.ceil(h / down).cast("int")
    byte = lambda i: F.conv(F.hex(F.substring("content", i + 1, F.lit(1))), 16, 10).cast("int")
    n = F.least(w * h + 2 * cw * ch, F.length("content"))

    def sample(i: Column) -> Column:
        late = i - w * h
        plane = F.when(late < 0, Y).when(late < cw * ch, U).otherwise(V)
        at, wide = F.when(late < 0, i).otherwise(late % (cw * ch)), F.when(late < 0, w).otherwise(cw)
        return F.struct(plane.alias("plane"), F.floor(at / wide).cast("int").alias("y"), (at % wide).cast("int").alias("x"), byte(i).alias("value"))

    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), sample))
    return media.select("media_id", F.inline(every))
