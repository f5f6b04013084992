"""Registered queries over whole texts and tables, against plain Python: nothing of the input is cut or filtered away."""

import math
import re
from collections import Counter

import pytest

from rasterflow.operators import pixels as px
from rasterflow.plans import relational, visual
from rasterflow.plans.views import pixels

SF = "/root/testdata/sf0.001"


def turns(spark, sf):
    """conv_id, turn, text of all conversations of sf."""
    return [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text").collect()]


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    """The smallest table's turns, and turns with white space at the start, an arrow, tags and breaks behind 80 characters."""
    at = str(tmp_path_factory.mktemp("turns"))
    hard = [(10**6, 0, " " * 90 + "late\n\n text"), (10**6, 1, "a --> b " * 30), (10**6, 2, "x" * 100 + "{\\i1}y{z} one\\Ntwo"), (10**6, 3, " \t\n"), (10**6, 4, "é🙂" * 100)]
    spark.createDataFrame(turns(spark, SF) + hard, "conv_id long, turn int, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def whole(spark, sf):
    """The cues with their whole texts, by conversation and number."""
    texts = {(c, t + 1): re.sub(r"\s+", " ", x, flags=re.ASCII).strip(" ") for c, t, x in turns(spark, sf) if x is not None}
    return {k: x for k, x in texts.items() if x}


def clock(ms, mark):
    return f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02}{mark}{ms % 1000:03}"


def line(no, mark):
    return f"{clock((no - 1) * 2500, mark)} --> {clock((no - 1) * 2500 + 2125, mark)}"


@pytest.mark.parametrize("name", ["srt_write", "srt_to_vtt"])
def test_subtitles_are_written_whole(spark, conversations, name):
    files = {}
    for (c, no), text in sorted(whole(spark, conversations).items()):
        files.setdefault(c, []).append(f"{no}\n{line(no, ',')}\n{text}" if name == "srt_write" else f"{line(no, '.')}\n{text}")
    want = {c: ("" if name == "srt_write" else "WEBVTT\n\n") + "\n\n".join(b) + "\n" for c, b in files.items()}
    assert {r.media_id: r.text for r in relational.QUERIES[name](spark, conversations).collect()} == want


@pytest.mark.parametrize("name", ["srt_parse", "vtt_parse"])
def test_subtitles_are_parsed_whole(spark, conversations, name):
    want = sorted((c, (no - 1) * 2.5, (no - 1) * 2.5 + 2.125, text) for (c, no), text in whole(spark, conversations).items())
    got = sorted((r.media_id, round(r.start_s, 6), round(r.end_s, 6), r.text) for r in relational.QUERIES[name](spark, conversations).collect())
    assert got == want and max(len(x[3]) for x in got) > 80


def test_tags_are_stripped_from_whole_texts(spark, conversations):
    def plain(text):
        return re.sub(r"(?i)\\n", "\n", re.sub(r"\{[^}]*\}", "", "{\\b1}" + text.replace("{", "") + "{\\i0}"))

    want = {(c, t): x if x is None else plain(x) for c, t, x in turns(spark, conversations)}
    assert {(r.conv_id, r.turn): r.plain for r in relational.QUERIES["ass_strip_tags"](spark, conversations).collect()} == want


def test_every_event_gets_a_note_name(spark):
    names = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
    want = sorted((e, f"{names[e % 128 % 12]}{e % 128 // 12 - 1}", e % 128) for (e,) in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect())
    assert sorted((r.event_id, r.name, r.number) for r in relational.QUERIES["note_name"](spark, SF).collect()) == want


def rounded(v):
    return math.floor(v + 0.5)


def second_images(spark):
    """media_id, x and the second image's r, g, b, a of each line item."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()
    return [(o, n - 1, s * 7 % 256, p * 3 % 256, o % 256, p * 5 % 256) for o, n, p, s in lines]


@pytest.mark.parametrize("name", ["premultiply", "unpremultiply"])
def test_every_line_item_is_multiplied(spark, name):
    def value(c, a):
        return rounded(c * a / 255) if name == "premultiply" else min(255, rounded(c * 255 / a)) if a else 0

    want = Counter((o, 0, x, value(r, a), value(g, a), value(b, a), a) for o, x, r, g, b, a in second_images(spark))
    assert Counter(tuple(r) for r in visual.QUERIES[name](spark, SF).select("media_id", "y", "x", *"rgba").collect()) == want


def test_every_pixel_is_masked_at_its_place(spark):
    mask = {}
    for o, x, *rgb in second_images(spark):
        mask[o, x] = tuple(map(max, mask.get((o, x), (0, 0, 0)), rgb))
    images = pixels(spark, SF).select("media_id", "y", "x", *"rgba").collect()
    want = Counter((o, y, x, r, g, b, rounded(a * (0.299 * mask[o, x][0] + 0.587 * mask[o, x][1] + 0.114 * mask[o, x][2]) / 255)) for o, y, x, r, g, b, a in images)
    assert Counter(tuple(r) for r in visual.QUERIES["apply_mask"](spark, SF).select("media_id", "y", "x", *"rgba").collect()) == want


def test_mask_edges_count_beyond_the_mask(spark):
    of = "media_id long, y int, x int, r int, g int, b int, a int"
    image = spark.createDataFrame([(1, y, x, 9, 9, 9, 255) for y in range(3) for x in range(3)], of)
    mask = spark.createDataFrame([(1, y, x, *[10 * y + x] * 3, 255) for y in range(2) for x in range(2)], of)
    assert {(r.y, r.x): r.a for r in px.apply_mask(image, mask).collect()} == {(y, x): 10 * min(y, 1) + min(x, 1) for y in range(3) for x in range(3)}
