"""MIDI files: parsed in Arrow batches to one row for each event, and written from event rows by hex arithmetic in columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channel events by the upper half of their status with their number of data bytes, and meta events by type.
CHANNEL = {0x8: ("note_off", 2), 0x9: ("note_on", 2), 0xA: ("aftertouch", 2), 0xB: ("controller", 2), 0xC: ("program", 1), 0xD: ("pressure", 1), 0xE: ("bend", 2)}
META = {0x00: "sequence_number", 0x01: "text", 0x02: "copyright", 0x03: "track_name", 0x04: "instrument_name", 0x05: "lyrics", 0x06: "marker", 0x07: "cue_point", 0x20: "channel_prefix", 0x2F: "end_of_track", 0x51: "set_tempo", 0x54: "smpte_offset", 0x58: "time_signature", 0x59: "key_signature"}
TEXTS = range(0x01, 0x08)

Event = tuple[int, int, int, int, str, int | None, int | None, int | None, int | None, str | None]


def number_at(raw: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the highest first, and where it ends; bytes that end before it does are an IndexError."""
    value = 0
    while True:
        byte = raw[at]
        value, at = value << 7 | byte & 127, at + 1
        if byte < 128:
            return value, at


def events_of(raw: bytes) -> Iterator[Event]:
    """(track, seq, delta, tick, kind, channel, first, second, value, text) of each event. A broken track ends where it breaks.

    value is the bend from -8192, the tempo in microseconds a beat, or the numerator's denominator of a time signature.
    """
    if raw[:4] != b"MThd":
        return
    at, track = 8 + int.from_bytes(raw[4:8], "big"), 0
    while at + 8 <= len(raw):
        end = at + 8 + int.from_bytes(raw[at + 4 : at + 8], "big")
        if raw[at : at + 4] == b"MTrk":
            try:
                yield from _track(raw[: min(end, len(raw))], at + 8, track)
            except IndexError:
                pass
            track += 1
        at = end


def _track(raw: bytes, at: int, track: int) -> Iterator[Event]:
    tick = seq = running = 0
    while at < len(raw):
        delta, at = number_at(raw, at)
        tick += delta
        status = raw[at] if raw[at] > 127 else running
        at += raw[at] > 127
        head = (track, seq, delta, tick)
        if status >> 4 in CHANNEL:
            running = status
            kind, n = CHANNEL[status >> 4]
            data = [raw[at + i] for i in range(n)]
            bend = (data[1] << 7 | data[0]) - 8192 if kind == "bend" else None
            yield (*head, kind, status & 15, data[0], data[1] if n > 1 else None, bend, None)
            at += n
        elif status in (0xF0, 0xF7, 0xFF):
            tag = raw[at] if status == 0xFF else None
            size, at = number_at(raw, at + (status == 0xFF))
            body = raw[at : at + size]
            at += size
            value = int.from_bytes(body[:3], "big") if tag == 0x51 and size >= 3 else 1 << body[1] if tag == 0x58 and size >= 2 and body[1] < 32 else None
            yield (*head, "sysex" if tag is None else META.get(tag, "unknown"), None, body[0] if size else None, body[1] if size > 1 else None, value, body.decode("utf-8", "replace") if tag in TEXTS else None)
        else:
            return
        seq += 1


COLUMNS = (("track", "integer"), ("seq", "integer"), ("delta", "long"), ("tick", "long"), ("kind", "string"), ("channel", "integer"), ("first", "integer"), ("second", "integer"), ("value", "long"), ("text", "string"))


def read_midi(media: DataFrame) -> DataFrame:
    """media_id and the columns of events_of() from media (media_id, content); what is no MIDI file has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string()}
        for b in batches:
            rows, found = [], []
            for i, content in enumerate(b.column(1).to_pylist()):
                own = list(events_of(content or b""))
                rows += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array([f[k] for f in found], kinds[t]) for k, (_, t) in enumerate(COLUMNS))], ["media_id", *(n for n, _ in COLUMNS)])

    schema = media.select("media_id").schema
    for name, kind in COLUMNS:
        schema = schema.add(name, kind)
    return media.select("media_id", "content").mapInArrow(run, schema)


def midi_header(media: DataFrame) -> DataFrame:
    """media_id, format, tracks, division."""
    short = lambda at: F.conv(F.hex(F.substring("content", at + 1, 2)), 16, 10).cast("int")
    return media.where((F.hex(F.substring("content", 1, 4)) == b"MThd".hex().upper()) & (F.length("content") >= 14)).select("media_id", short(8).alias("format"), short(10).alias("tracks"), short(12).alias("division"))


def number_hex(n: Column) -> Column:
    """A number in as many groups of seven bits as it takes, as hex; less than 0 is 0. Readers that keep to the standard take four groups, numbers under 2 ** 28."""
    n = F.greatest(n.cast("long"), F.lit(0).cast("long"))
    group = lambda k: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127).bitwiseOR(128 if k else 0)), 2, "0")
    return F.concat(*[F.when(n >= 1 << 7 * k, group(k)).otherwise("") for k in range(8, 0, -1)], group(0))


def write_midi(notes: DataFrame, division: int = 480, tempo: int = 500_000, channel: int = 0) -> DataFrame:
    """media_id, content: one file of one track from note events (media_id, tick, on, note, velocity), with a tempo first and an end last."""
    order = Window.partitionBy("media_id").orderBy("tick", "on", "note", "velocity")
    delta = F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0).cast("long"))
    two = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    code = F.concat(number_hex(delta), F.when(F.col("on"), F.lit(f"9{channel:X}")).otherwise(F.lit(f"8{channel:X}")), two(F.col("note")), two(F.col("velocity")))
    rows = notes.withColumns({"code": code, "place": F.row_number().over(order)})
    tracks = rows.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "").alias("body"))
    track = F.concat(F.lit(f"00FF5103{tempo:06X}"), F.col("body"), F.lit("00FF2F00"))
    size = F.lpad(F.hex((F.length(track) / 2).cast("long")), 8, "0")
    return tracks.select("media_id", F.unhex(F.concat(F.lit(f"{b'MThd'.hex()}0000000600000001{division:04X}{b'MTrk'.hex()}"), size, track)).alias("content"))
