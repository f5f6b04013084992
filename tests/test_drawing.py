"""Drawing, metadata and audio on small inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from rasterflow.operators import draw
from rasterflow.sources import metadata

SF = "/root/testdata/sf0.001"


def cells(spark, n=9):
    return spark.range(n * n).select(F.lit(1).alias("media_id"), F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), *[F.lit(0).alias(c) for c in "rgba"])


def inside(spark, condition):
    return {(r.x, r.y) for r in cells(spark).where(condition).collect()}


def stepped(x0, y0, x1, y1):
    """The line by an error sum, step by step."""
    dx, dy, out = abs(x1 - x0), abs(y1 - y0), set()
    sx, sy, err = 1 if x0 < x1 else -1, 1 if y0 < y1 else -1, dx - dy
    while True:
        out.add((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        twice = 2 * err
        if twice > -dy:
            err, x0 = err - dy, x0 + sx
        if twice < dx:
            err, y0 = err + dx, y0 + sy


@pytest.mark.parametrize("ends", [(0, 0, 8, 4), (8, 4, 0, 0), (1, 7, 4, 0), (2, 2, 2, 2), (3, 8, 3, 1), (0, 5, 8, 5), (0, 0, 4, 8), (7, 1, 0, 6)])
def test_line(spark, ends):
    assert inside(spark, draw.line(*ends)) == stepped(*ends)


def test_polygon(spark):
    assert inside(spark, draw.polygon([(1, 1), (5, 1), (5, 4), (1, 4)])) == {(x, y) for x in range(1, 6) for y in range(1, 4)}
    assert inside(spark, draw.polygon([(1, 1), (5, 1)])) == set()
    assert (4, 1) in inside(spark, draw.polygon([(4, 1), (8, 5), (0, 5)]))  # a vertex is a span of one pixel


def test_paint(spark):
    out = draw.paint(cells(spark, 2), F.col("x") == 1, (100, 200, 50, 128)).where("y = 0").orderBy("x").collect()
    assert tuple(out[0])[3:] == (0, 0, 0, 0) and tuple(out[1])[3:] == (50, 100, 25, 128)


def exif(order):
    def entry(tag, kind, n, value):
        return struct.pack(order + "HHI", tag, kind, n) + value

    first = struct.pack(order + "H", 2) + entry(0x10F, 2, 4, b"abc\0") + entry(0x112, 3, 1, struct.pack(order + "HH", 6, 0)) + struct.pack(order + "I", 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + first


def test_exif(spark):
    block = exif(">")
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(block)) + b"Exif\0\0" + block + b"\xff\xda"
    df = spark.createDataFrame([(1, exif("<")), (2, jpeg), (3, b"no"), (4, None), (5, exif("<")[:20])], "media_id int, content binary")
    found = {r.media_id: (r.make, r.orientation) for r in metadata.exif_summary(metadata.exif_entries(df)).collect()}
    assert found == {1: ("abc", 6), 2: ("abc", 6)}


def test_icc(spark):
    profile = bytearray(128)
    profile[0:4], profile[8:10], profile[12:24], profile[36:40] = struct.pack(">I", 128), b"\x04\x20", b"mntrRGB XYZ ", b"acsp"
    df = spark.createDataFrame([(1, bytes(profile)), (2, b"x" * 200), (3, None)], "media_id int, content binary")
    assert [tuple(r) for r in metadata.icc_headers(df).collect()] == [(1, 128, "4.2", "mntr", "RGB", "XYZ")]


def test_broken_audio(spark):
    row = metadata.decode_audio(spark.createDataFrame([(1, b"RIFFxxxxWAVE"), (2, None)], "media_id int, content binary")).collect()
    assert all(r.samples is None and r.error for r in row)


def stamped(n, x0, y0, x1, y1, width, colour, below):
    """Discs along the line, laid on one by one."""
    out, (*rgb, a) = {(y, x): below for y in range(n) for x in range(n)}, colour
    dx, dy, sx, sy = abs(x1 - x0), abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1
    err, x, y, r = dx - dy, x0, y0, int(width / 2 + 0.5)
    while True:
        for v in range(-r, r + 1):
            for u in range(-r, r + 1):
                at = (y + v, x + u)
                if at in out and u * u + v * v <= r * r:
                    out[at] = (*(int(p * a / 255 + q * (1 - a / 255) + 0.5) for p, q in zip(rgb, out[at][:3], strict=True)), max(a, out[at][3]))
        if (x, y) == (x1, y1):
            return out
        twice = 2 * err
        x, err = (x + sx, err - dy) if twice > -dy else (x, err)
        y, err = (y + sy, err + dx) if twice < dx else (y, err)


@pytest.mark.parametrize("ends", [(1, 2, 9, 5), (9, 5, 1, 2), (3, 9, 1, 0), (1, 0, 3, 9), (8, 1, 2, 7), (0, 6, 10, 6), (5, 10, 5, 0), (4, 4, 4, 4), (-3, 2, 14, 8)])
def test_wide_lines_in_all_directions(spark, ends):
    for width in (2, 3, 5, 7):
        got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in draw.draw_line(cells(spark, 11), *ends, (200, 100, 7, 128), width).collect()}
        assert got == stamped(11, *ends, width, (200, 100, 7, 128), (0, 0, 0, 0))


@pytest.mark.parametrize("rx,ry", [(1, 1), (3, 2), (2, 4), (4, 1), (4, 4)])
def test_ellipse_outline(spark, rx, ry):
    times = {}
    for k, row in enumerate(draw.ellipse_steps(rx, ry)[0]):
        times[k, row] = 1
    for k, column in enumerate(draw.ellipse_steps(rx, ry)[1]):
        times[column, k] = times.get((column, k), 0) + 1
    want = {(dy, dx): n * (1 + (dx == 0)) * (1 + (dy == 0)) for (dx, dy), n in times.items()}
    got = draw.draw_ellipse(cells(spark, 11), 5, 5, rx, ry, (255, 0, 0, 128)).collect()
    lay = lambda n: 0 if n == 0 else int(128 + lay(n - 1) * (1 - 128 / 255) + 0.5)
    assert {(r.y, r.x): r.r for r in got} == {(y, x): lay(want.get((abs(y - 5), abs(x - 5)), 0)) for y in range(11) for x in range(11)}
    assert all(abs((x / rx) ** 2 + (y / ry) ** 2 - 1) < 0.8 for y, x in want) and {(0, rx), (ry, 0)} <= set(want)


def test_filled_ellipse(spark):
    got = {(r.y, r.x): r.r for r in draw.draw_ellipse(cells(spark, 11), 5, 5, 4, 3, (255, 0, 0, 255), (9, 0, 0, 255)).collect()}
    assert got[5, 5] == 9 and got[5, 9] == 255 and got[2, 5] == 255 and got[0, 0] == 0
