"""MIDI bytes, profiles, outlines and packets: broken and empty inputs, and files spelt out by hand."""

import struct
import zlib

from pyspark.sql import functions as F
from rasterflow.operators import draw, timed
from rasterflow.sources import metadata, notes


def test_numbers_of_seven_bit_groups(spark):
    values = [0, 64, 127, 128, 8192, 16383, 16384, 2097151, 2097152, 268435455]
    known = ["00", "40", "7F", "8100", "C000", "FF7F", "818000", "FFFF7F", "81808000", "FFFFFF7F"]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", notes.number_hex(F.col("v")).alias("h")).collect()
    assert [r.h for r in got] == known and [notes.number_at(bytes.fromhex(h), 0)[0] for h in known] == values


def test_numbers_of_more_than_four_groups(spark):
    values = [2**28 - 1, 2**28, 1_773_285_600, 2**35, 2**63 - 1]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v long").select(notes.number_hex(F.col("v")).alias("h")).collect()]
    assert got[:3] == ["FFFFFF7F", "8180808000", "86CDC8E160"] and [notes.number_at(bytes.fromhex(h), 0) for h in got] == [(v, len(h) // 2) for v, h in zip(values, got, strict=True)]
    events = [(1, 2**28 + 5, True, 60, 90), (1, 2**29 + 2**28 + 7, False, 60, 0)]
    back = notes.read_midi(notes.write_midi(spark.createDataFrame(events, "media_id long, tick long, on boolean, note int, velocity int"))).where("kind LIKE 'note%'").orderBy("seq").collect()
    assert [r.tick for r in back] == [e[1] for e in events]


def test_broken_midi(spark):
    whole = bytes.fromhex("4D546864000000060000000101E0" + "4D54726B0000000C" + "00903C40" + "830060" + "3C00" + "00FF2F")
    files = [whole, whole[:24], b"MThd", b"", None, b"no file"]
    df = spark.createDataFrame(list(enumerate(map(lambda x: None if x is None else bytearray(x), files))), "media_id long, content binary")
    rows = [tuple(r)[:6] for r in notes.read_midi(df).orderBy("media_id", "seq").collect()]
    assert rows[:2] == [(0, 0, 0, 0, 0, "note_on"), (0, 0, 1, 384, 384, "note_on")] and {r[0] for r in rows} <= {0, 1}
    assert [tuple(r) for r in notes.midi_header(df).collect()] == [(0, 0, 1, 480), (1, 0, 1, 480)]


def test_written_notes_read_back(spark):
    events = [(1, 0, True, 60, 90), (1, 480, False, 60, 0), (1, 480, True, 64, 90), (1, 300480, False, 64, 0)]
    df = spark.createDataFrame(events, "media_id long, tick long, on boolean, note int, velocity int")
    back = notes.read_midi(notes.write_midi(df)).where("kind LIKE 'note%'").orderBy("seq").collect()
    assert [(r.tick, r.kind == "note_on", r.first, r.second) for r in back] == [e[1:] for e in events]


def profile():
    body = b"desc\0\0\0\0\0\0\0\x03Hi\0\0"
    return struct.pack(">I", 160) + b"\0" * 32 + b"acsp" + b"\0" * 88 + struct.pack(">I4sII", 1, b"desc", 144, 16) + body


def test_profiles_are_found(spark):
    raw = profile()
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 5 + len(zlib.compress(raw))) + b"iCCP" + b"abc\0\0" + zlib.compress(raw) + b"crc!"
    files = [raw, png, b"\xff\xd8\xff\xe2", b"", None, raw[:100], b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x05iCCPab\0\0x"]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "media_id long, content binary")
    got = [(r.media_id, r.tag, r.kind, r.text) for r in metadata.icc_tags(metadata.icc_profiles(df)).orderBy("media_id").collect()]
    assert got == [(0, "desc", "desc", "Hi"), (1, "desc", "desc", "Hi")]


def test_outline_of_circles():
    assert draw.circle_steps(0) == [0] and draw.circle_steps(3) == [3, 2] and draw.circle_steps(1) == [1]


def test_packets_over_pages(spark):
    rows = [(1, 0, 0, 255), (1, 0, 1, 255), (1, 1, 0, 10), (1, 1, 1, 0), (1, 2, 0, 255)]
    df = spark.createDataFrame(rows, "media_id long, page long, i long, size long")
    assert sorted(tuple(r) for r in timed.laced_packets(df).collect()) == [(1, 0, 520, 2, True), (1, 1, 0, 1, True), (1, 2, 255, 1, False)]
