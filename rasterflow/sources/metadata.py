"""Metadata as rows: EXIF entries of JPEG and TIFF blocks, colour profile headers, and audio files.

The byte reading is a small row function in Arrow batches; what the entries mean is decided by DataFrame expressions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .media import decode_wav, encode_wav

#: Bytes of a value by type: 1 byte, 2 ASCII, 3 short, 4 long, 5 rational, 7 opaque, 9 signed long, 10 signed rational.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: Tags that hold the place of another directory, and its name.
CHILDREN = {0x8769: "exif", 0x8825: "gps"}


def exif_block(raw: bytes) -> bytes | None:
    """The TIFF block in raw: raw itself, or what a JPEG's APP1 segment holds."""
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return raw
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            return raw[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def tiff_entries(block: bytes) -> Iterator[tuple[str, int, int, list[float], str | None]]:
    """(directory, tag, type, numbers, text) of the main directory and of those that it names; broken entries are left out."""
    order = "<" if block[:2] == b"II" else ">"
    todo = [("main", struct.unpack_from(order + "I", block, 4)[0])] if len(block) >= 8 else []
    seen = set()
    while todo:
        name, at = todo.pop()
        if at in seen or at + 2 > len(block):
            continue
        seen.add(at)
        count = struct.unpack_from(order + "H", block, at)[0]
        for start in range(at + 2, at + 2 + 12 * count, 12):
            if start + 12 > len(block):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", block, start)
            size = SIZES.get(kind, 0) * n
            where = start + 8 if size <= 4 else struct.unpack_from(order + "I", block, start + 8)[0]
            body = block[where : where + size]
            if not size or len(body) < size:
                continue
            if kind == 2:
                yield name, tag, kind, [], body.split(b"\0")[0].decode("utf-8", "replace")
                continue
            code = {1: "u1", 7: "u1", 3: "u2", 4: "u4", 5: "u4", 9: "i4", 10: "i4"}[kind]
            numbers = np.frombuffer(body, dtype=code if code == "u1" else order + code).astype(float)
            if kind in (5, 10):
                over, under = numbers[::2], numbers[1::2]
                numbers = np.divide(over, under, out=np.zeros_like(over), where=under != 0)
            if tag in CHILDREN and kind == 4:
                todo.append((CHILDREN[tag], int(numbers[0])))
            yield name, tag, kind, numbers.tolist(), None


def exif_entries(media: DataFrame) -> DataFrame:
    """media_id, directory, tag, type, numbers, text: a row for each entry of each content; contents without a block have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, content in enumerate(b.column(1).to_pylist()):
                block = exif_block(content or b"")
                own = list(tiff_entries(block)) if block else []
                rows += [i] * len(own)
                found += own
            types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], ["media_id", "directory", "tag", "type", "numbers", "text"])

    schema = media.select("media_id").schema.add("directory", "string").add("tag", "integer").add("type", "integer").add("numbers", T.ArrayType(T.DoubleType())).add("text", "string")
    return media.select("media_id", "content").mapInArrow(run, schema)


def exif_summary(entries: DataFrame) -> DataFrame:
    """media_id, make, model, software, taken_at, orientation, width, height, latitude, longitude, altitude: one row for each media_id with entries.

    South, west and below sea level are negative; later entries win over earlier ones only by their directory.
    """
    at = lambda directory, tag: (F.col("directory") == directory) & (F.col("tag") == tag)
    text = lambda directory, tag: F.max(F.when(at(directory, tag), F.col("text")))
    number = lambda directory, tag: F.max(F.when(at(directory, tag), F.get("numbers", F.lit(0))))
    angle = lambda tag: F.max(F.when(at("gps", tag), F.get("numbers", F.lit(0)) + F.coalesce(F.get("numbers", F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get("numbers", F.lit(2)), F.lit(0.0)) / 3600))
    signed = lambda value, ref, minus: F.when(ref == minus, -value).otherwise(value)
    return entries.groupBy("media_id").agg(
        text("main", 0x10F).alias("make"),
        text("main", 0x110).alias("model"),
        text("main", 0x131).alias("software"),
        F.coalesce(text("exif", 0x9003), text("main", 0x132)).alias("taken_at"),
        number("main", 0x112).cast("long").alias("orientation"),
        F.coalesce(number("exif", 0xA002), number("main", 0x100)).cast("long").alias("width"),
        F.coalesce(number("exif", 0xA003), number("main", 0x101)).cast("long").alias("height"),
        signed(angle(2), text("gps", 1), "S").alias("latitude"),
        signed(angle(4), text("gps", 3), "W").alias("longitude"),
        signed(number("gps", 6), number("gps", 5), 1).alias("altitude"),
    )


def icc_headers(media: DataFrame) -> DataFrame:
    """media_id, size, version, profile_class, color_space, connection_space from contents that are colour profiles; others have no row."""
    part = lambda start, n: F.substring("content", start + 1, n)
    ascii4 = lambda start: F.trim(F.decode(part(start, 4), "US-ASCII"))
    major, minor = (F.conv(F.hex(part(k, 1)), 16, 10).cast("int") for k in (8, 9))
    found = media.where((F.length("content") >= 128) & (F.hex(part(36, 4)) == "61637370"))
    return found.select("media_id", F.conv(F.hex(part(0, 4)), 16, 10).cast("long").alias("size"), F.concat_ws(".", major, F.shiftright(minor, 4)).alias("version"), ascii4(12).alias("profile_class"), ascii4(16).alias("color_space"), ascii4(20).alias("connection_space"))


def encode_audio(audio: DataFrame) -> DataFrame:
    """media_id, format, content: WAV files of 16 bits from audio (media_id, sample_rate, samples), an array for each channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [encode_wav(np.array(s, dtype=float).T, r) for r, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["wav"] * len(out), pa.string()), pa.array(out, pa.binary())], ["media_id", "format", "content"])

    df = audio.select("media_id", "sample_rate", "samples")
    return df.mapInArrow(run, audio.select("media_id").schema.add("format", "string").add("content", "binary"))


def decode_audio(media: DataFrame) -> DataFrame:
    """media_id, sample_rate, samples (array<array<double>>, one for each channel), error from media (media_id, content)."""

    def one(content: bytes | None) -> tuple:
        try:
            rate, samples = decode_wav(content or b"")
            return rate, samples.T.tolist(), None
        except (ValueError, KeyError, struct.error, UnboundLocalError) as e:
            return None, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(c) for c in b.column(1).to_pylist()]
            types = (pa.int32(), pa.list_(pa.list_(pa.float64())), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(types))], ["media_id", "sample_rate", "samples", "error"])

    schema = media.select("media_id").schema.add("sample_rate", "integer").add("samples", T.ArrayType(T.ArrayType(T.DoubleType()))).add("error", "string")
    return media.select("media_id", "content").mapInArrow(run, schema)


# --- colour profiles ---


def profile_bytes(raw: bytes) -> bytes | None:
    """The profile in raw: raw itself, the numbered APP2 segments of a JPEG, or a PNG's iCCP chunk; null without one."""
    if raw[36:40] == b"acsp":
        return raw
    if raw[:2] == b"\xff\xd8":
        parts, at = {}, 2
        while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + size]
            if raw[at + 1] == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) > 14:
                parts[body[12]] = body[14:]
            at += 2 + max(size, 2)
        return b"".join(parts[k] for k in sorted(parts)) if parts else None
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(raw):
            size = int.from_bytes(raw[at : at + 4], "big")
            if raw[at + 4 : at + 8] == b"iCCP":
                name, _, packed = raw[at + 8 : at + 8 + size].partition(b"\0")
                try:
                    return zlib.decompress(packed[1:])
                except zlib.error:
                    return None
            at += 12 + size
    return None


def icc_profiles(media: DataFrame) -> DataFrame:
    """media_id, content: the colour profile in each file of media (media_id, content); files without one have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([profile_bytes(c or b"") for c in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["media_id", "content"]).filter(found.is_valid())

    return media.select("media_id", "content").mapInArrow(run, media.select("media_id", "content").schema)


def icc_tags(media: DataFrame) -> DataFrame:
    """media_id, tag, kind, text, x, y, z, gamma, curve: one row for each tag of each profile in media (media_id, content).

    text is of desc, mluc (the first record) and text tags, x, y, z of XYZ tags; gamma is of curv tags without a table and of
    para tags, curve the table of curv tags from 0 to 1. What a kind doesn't have is null.
    """
    part = lambda at, n: F.substr(F.col("content"), (at + 1).cast("int"), F.lit(n) if isinstance(n, int) else n.cast("int"))
    whole = lambda at, n=4: F.conv(F.hex(part(at, n)), 16, 10).cast("long")
    fixed = lambda at: F.when(whole(at) > 0x7FFFFFFF, whole(at) - (1 << 32)).otherwise(whole(at)) / 65536
    ascii_ = lambda at, n: F.trim(F.regexp_replace(F.decode(part(at, n), "ISO-8859-1"), "(?s)\\x00.*", ""))
    valid = media.where((F.length("content") >= 132) & (F.hex(F.substring("content", 37, 4)) == "61637370"))
    count = F.conv(F.hex(F.substring("content", 129, 4)), 16, 10).cast("int")
    fits = F.least(count, F.floor((F.length("content") - 132) / 12).cast("int"))
    each = valid.where(fits > 0).select("media_id", "content", F.explode(F.transform(F.sequence(F.lit(0), fits - 1), lambda i: i * 12 + 132)).alias("entry"))
    tags = each.select("media_id", "content", ascii_(F.col("entry"), 4).alias("tag"), whole(F.col("entry") + 4).alias("at"), whole(F.col("entry") + 8).alias("size"))
    at, size = F.col("at"), F.col("size")
    known = tags.where(at + size <= F.length("content")).withColumn("kind", ascii_(at, 4))
    kind = F.col("kind")
    wide = F.regexp_replace(F.decode(part(at + whole(at + 24), whole(at + 20)), "UTF-16BE"), "(?s)\\x00.*", "")
    text = F.when(kind == "desc", ascii_(at + 12, whole(at + 8) - 1)).when((kind == "mluc") & (whole(at + 8) > 0), wide).when(kind == "text", ascii_(at + 8, size - 8))
    points = whole(at + 8)
    gamma = F.when((kind == "curv") & (points == 0), F.lit(1.0)).when((kind == "curv") & (points == 1), whole(at + 12, 2) / 256).when(kind == "para", fixed(at + 12))
    table = F.transform(F.sequence(F.lit(0).cast("long"), F.least(points, F.floor((size - 12) / 2)) - 1), lambda i: F.conv(F.hex(part(F.col("at") + 12 + i * 2, 2)), 16, 10).cast("double") / 65535)
    curve = F.when((kind == "curv") & (points > 1) & (size >= 14), table)
    return known.select("media_id", "tag", "kind", text.alias("text"), *[F.when(kind == "XYZ", fixed(at + 8 + 4 * i)).alias(c) for i, c in enumerate("xyz")], gamma.alias("gamma"), curve.alias("curve"))
