"""Column functions, packed rasters and codecs on small inputs."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.functions import color, sniff
from rasterflow.functions import timecode as tc
from rasterflow.functions.rounding import half_up, wrapped
from rasterflow.operators import pixels as px
from rasterflow.operators import raster as rs
from rasterflow.operators import timed
from rasterflow.sources import media


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_rounding(spark):
    assert tuple(one(spark, half_up(F.lit(-2.5)), half_up(F.lit(2.5)), wrapped(F.lit(-1)), wrapped(F.lit(300)))) == (-2, 3, 255, 44)


def test_colours(spark):
    rgb = (F.lit(255), F.lit(0), F.lit(0))
    assert tuple(one(spark, *color.rgb_to_hsl(rgb))) == (0.0, 100.0, 50.0)
    assert tuple(one(spark, *color.hsl_to_rgb(F.lit(120.0), F.lit(100.0), F.lit(50.0)))) == (0, 255, 0)
    assert tuple(one(spark, *color.rgb_to_cmyk((F.lit(0),) * 3))) == (0.0, 0.0, 0.0, 100.0)
    lab = one(spark, *color.rgb_to_lab((F.lit(255),) * 3))
    assert abs(lab[0] - 100) < 0.01 and abs(lab[1]) < 0.02 and abs(lab[2]) < 0.02


def gray(spark, array, media_id=1):
    h, w = array.shape
    return spark.createDataFrame([(media_id, w, h, [int(v) for v in array.reshape(-1)])], "media_id long, width int, height int, v array<int>")


def channel(df, h, w):
    return np.array(df.first()["v"]).reshape(h, w)


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (4, 1), (3, 5)])
def test_geometry(spark, shape):
    h, w = shape
    a = np.random.default_rng(42).integers(0, 256, shape)
    df = gray(spark, a)
    width, height = F.col("width"), F.col("height")
    for fn, want in ((rs.flip_horizontal, a[:, ::-1]), (rs.flip_vertical, a[::-1]), (rs.rotate_180, a[::-1, ::-1]), (rs.rotate_90, np.rot90(a, -1)), (rs.rotate_270, np.rot90(a))):
        assert (channel(df.withColumn("v", fn(F.col("v"), width, height)), *want.shape) == want).all(), fn
    big = channel(df.withColumn("v", rs.extend(F.col("v"), width, height, 1, 1, 1, 1, 7)), h + 2, w + 2)
    assert (big == np.pad(a, 1, constant_values=7)).all()
    same = channel(df.withColumn("v", rs.resize_lanczos(F.col("v"), width, height, w, h)), h, w)
    assert (same == a).all()


def test_crop_outside_fails(spark):
    df = gray(spark, np.zeros((2, 2)))
    with pytest.raises(Exception, match="crop outside"):
        df.select(rs.crop(F.col("v"), 2, 2, 1, 1, 2, 2)).collect()


def test_filters(spark):
    a = np.random.default_rng(1).integers(0, 256, (6, 5))
    df = gray(spark, a)
    pad = np.pad(a, 1, mode="edge")
    near = np.stack([pad[j : j + 6, i : i + 5] for j in range(3) for i in range(3)])
    w, h = F.col("width"), F.col("height")
    assert (channel(df.withColumn("v", rs.median(F.col("v"), w, h)), 6, 5) == np.sort(near, axis=0)[4]).all()
    mean = np.floor(near.sum(axis=0) / 9 + 0.5)
    assert (channel(df.withColumn("v", rs.convolve(F.col("v"), w, h, [[1.0] * 3] * 3)), 6, 5) == mean).all()
    flat = rs.gradient_edges(gray(spark, np.full((3, 3), 9)), "v", rs.SOBEL)
    assert set(channel(flat, 3, 3).reshape(-1).tolist()) == {181}
    assert abs(sum(rs.gaussian_kernel(2)) - 1) < 1e-12 and not math.isnan(rs.gaussian_kernel(1)[0])


def test_histogram_of_gradient(spark):
    df = spark.createDataFrame([(1, 0, x, x, x, x, 255) for x in range(256)], "media_id int, y int, x int, r int, g int, b int, a int")
    stats = {r.channel: r for r in px.channel_stats(px.histogram(df)).collect()}
    assert stats["red"].min == 0 and stats["red"].max == 255 and stats["red"].median == 127 and abs(stats["red"].mean - 127.5) < 1e-9
    assert px.equalize(df).agg(F.min("r"), F.max("r")).first()[:] == (0, 255)
    # The percentile 0 is bin 0, whatever the image holds.
    assert px.normalize(df.where("x between 50 and 99")).agg(F.min("r"), F.max("r")).first()[:] == (129, 255)


def test_times_and_names(spark):
    got = one(spark, tc.parse_clock(F.lit("01:02:03,004")), tc.parse_clock(F.lit("bad")), tc.format_clock(F.lit(3723.004)), tc.format_clock(F.lit(1.9996)), tc.parse_cue(F.lit("07:32:10")), tc.format_cue(F.lit(33910)), tc.note_name(F.lit(60)), tc.note_number(F.lit("C4")), tc.note_number(F.lit("H1")))
    assert tuple(got) == (3723.004, 0.0, "01:02:03,004", "00:00:01,1000", 33910, "07:32:10", "C4", 60, -1)
    assert tuple(one(spark, sniff.format_of_name(F.lit("a/b.JPG")), sniff.format_of_name(F.lit("x")), sniff.human_bytes(F.lit(1536)), sniff.mime_type(F.lit("svg")))) == ("jpeg", None, "1.5 KB", "image/svg+xml")
    assert sniff.glob_regex("a/**/*.p?g") == "^a/.*/[^/]*\\.p.g$"


def test_subtitles(spark):
    text = "﻿1\r\n00:00:01,000 --> 00:00:04,000\r\nHello\r\n\r\nx\r\nbad\r\n\r\n3\r\n00:00:10.000 --> 00:00:15,000\r\ntwo\r\nlines\r\n"
    rows = timed.read_srt(spark.createDataFrame([(1, text)], "media_id int, text string")).orderBy("idx").collect()
    assert [(r.idx, r.start_s, r.end_s, r.text) for r in rows] == [(1, 1.0, 4.0, "Hello"), (3, 10.0, 15.0, "two\nlines")]


def test_codecs(spark):
    r = np.random.default_rng(0)
    data = r.integers(0, 256, 7 * 5 * 4, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([(1, 7, 5, bytearray(data))], "media_id long, width int, height int, data binary")
    for fmt in media.ENCODERS:
        got = media.decode(media.encode(df, fmt)).first()
        assert (got.width, got.height, bytes(got.data), got.error) == (7, 5, data, None)
    bad = spark.createDataFrame([(1, "png", bytearray(b"junk")), (2, None, None)], "media_id long, format string, content binary")
    assert all(x.error and x.data is None for x in media.decode(bad).collect())
    rate, samples = media.decode_wav(media.encode_wav(np.sin(np.arange(100) / 9)[:, None], 8000))
    assert rate == 8000 and abs(samples[:, 0] - np.sin(np.arange(100) / 9)).max() < 1e-4


@pytest.mark.parametrize("kind", range(5))
def test_png_row_filters(kind):
    r = np.random.default_rng(kind)
    w, h = 6, 4
    px_ = r.integers(0, 256, (h, w * 3)).astype(int)
    lines = []
    for y in range(h):
        up = px_[y - 1] if y else np.zeros(w * 3, int)
        left = np.concatenate(([0] * 3, px_[y][:-3]))
        corner = np.concatenate(([0] * 3, up[:-3]))
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (0, left, up, (left + up) // 2, paeth)[kind]
        lines.append(bytes([kind]) + ((px_[y] - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    got = np.frombuffer(media.decode_png(raw)[2], dtype=np.uint8).reshape(h, w, 4)
    assert (got[:, :, :3].reshape(h, w * 3) == px_).all() and (got[:, :, 3] == 255).all()


def test_source_and_sink(spark, tmp_path):
    df = spark.createDataFrame([(f"m{i}", 2, 2, bytearray(bytes(range(16)))) for i in range(3)], "media_id string, width int, height int, data binary")
    spark.dataSource.register(media.MediaSink)
    media.encode(df, "bmp").write.format("media").mode("append").save(str(tmp_path / "out"))
    found = media.read_media(spark, str(tmp_path / "out"), "*.bmp")
    assert {r.format for r in found.collect()} == {"bmp"} and found.count() == 3
    assert media.decode(found, failfast=True).where("width = 2").count() == 3


MEDIA = "media_id string, format string, content binary"


def left_in(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def save(spark, rows, folder, mode="append"):
    spark.dataSource.register(media.MediaSink)
    spark.createDataFrame(rows, MEDIA).repartition(3).write.format("media").mode(mode).save(str(folder))


def test_sink_keeps_names_apart(spark, tmp_path):
    rows = [("a/b", "x", b"1"), ("a_b", "x", b"2"), ("a%2Fb", "x", b"3"), ("a/b", "y", b"4"), ("..", "x", b"5"), ("\u00e9 +", "x", b"6"), ("_a", "x", b"7")]
    save(spark, rows, tmp_path)
    found = media.read_media(spark, str(tmp_path)).withColumn("id", media.file_id(F.col("media_id"))).collect()
    assert sorted((r.id, bytes(r.content)) for r in found) == sorted((i, c) for i, _, c in rows)
    save(spark, [("a_b", "x", b"new")], tmp_path)
    assert len(left_in(tmp_path)) == 7 and left_in(tmp_path)["a_b.x"] == b"new"
    save(spark, [("z", "x", b"only")], tmp_path, "overwrite")
    assert left_in(tmp_path) == {"z.x": b"only"}


@pytest.mark.parametrize("broken", [[("b", "x", None)], [(None, "x", b"1")], [("", "x", b"1")], [("a1", "x", b"twice")]])
def test_failing_job_leaves_no_file(spark, tmp_path, broken):
    (tmp_path / "before.x").write_bytes(b"kept")
    with pytest.raises(Exception):  # noqa: B017
        save(spark, [(f"a{i}", "x", b"1") for i in range(20)] + broken, tmp_path, "overwrite")
    assert left_in(tmp_path) == {"before.x": b"kept"} and not list(tmp_path.glob("_temporary*"))


def test_task_tried_again_leaves_each_file_once(tmp_path):
    writer = media._Writer(str(tmp_path), ["media_id", "format", "content"], False)
    rows = [("a", "x", b"1"), ("b", "x", b"2")]
    with pytest.raises(ValueError):
        writer.write(iter([*rows, ("c", "x", None)]))
    slow = writer.write(iter(rows))  # an attempt that another one overtook
    writer.commit([writer.write(iter(rows)), None])
    assert left_in(tmp_path) == {"a.x": b"1", "b.x": b"2"} and slow.names == ["a.x", "b.x"]
