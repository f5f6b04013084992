"""Wrapping and rendering of text, and files that the library's writers don't make, against plain Python."""

from pyspark.sql import functions as F
from rasterflow.operators import scripts as sc
from rasterflow.operators import text as tx

WORDS = "a bb ccc dddd eeeee\n\nffffff  g hhhhhhhhhhhhh i\n "


def wrapped(text, wrap, advance, spacing):
    width = lambda s: max(0, len(s) * (advance + spacing) - spacing)
    out = []
    for raw in text.split("\n"):
        if not raw:
            out.append("")
            continue
        line = ""
        for word in raw.split(" "):
            longer = f"{line} {word}" if line else word
            if width(longer) > wrap and line:
                out.append(line)
                line = word
            else:
                line = longer
        out += [line] if line else []
    return out


def test_wrap_and_measure(spark):
    df = spark.createDataFrame([(WORDS,), ("",), (None,)], "text string")
    for wrap in (8, 40, 63, 500):
        lines = [r.lines for r in df.select(tx.text_lines(F.col("text"), wrap, 8, 1).alias("lines")).collect()]
        assert lines == [wrapped(WORDS, wrap, 8, 1), [""], None]
    size = df.select(tx.measure_text(F.col("text"), 10).alias("s")).first().s
    assert (size.width, size.height, size.lines) == (max(map(len, WORDS.split("\n"))) * 8, 40, 4)


def test_render(spark):
    font = {65: [128, 0, 0, 0, 0, 0, 0, 1], 63: [255] + [0] * 7}
    df = spark.createDataFrame([(1, "A\né"), (2, None), (3, "")], "media_id long, text string")
    got = {tuple(r) for r in tx.render_text(df, font, 63).collect()}
    assert got == {(1, 0, 0), (1, 7, 7), *((1, 8, x) for x in range(8))}
    right = {tuple(r) for r in tx.render_text(df, font, 63, "right", wrap=20).collect()}
    assert (1, 0, 12) in right and (1, 7, 19) in right


def test_attributes(spark):
    line = 'A=1,B="x,C=9",C=2,EMPTY=,B="last"'
    got = spark.range(1).select(*[sc.attribute(F.lit(line), n).alias(n) for n in ("A", "B", "C", "EMPTY", "D")]).first()
    assert tuple(got) == ("1", "last", "2", "", None)


def test_broken_files_give_no_rows(spark):
    files = spark.createDataFrame([(1, None), (2, ""), (3, "no such thing\r\n\r\n-->"), (4, "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=x\n")], "media_id long, text string")
    for read in (sc.master_variants, sc.master_renditions, sc.read_cue, sc.vtt_regions, sc.vtt_styles, sc.ass_events, sc.ass_styles, sc.subtitle_info):
        assert read(files).count() == 0, read.__name__


def test_subtitle_formats(spark):
    texts = ["﻿WEBVTT\n", "1\r\n00:00:01,000 --> 00:00:02,000\r\nx", "1\nno time", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(sc.subtitle_format(F.col("text"))).collect()] == ["vtt", "srt", None, None, None]
