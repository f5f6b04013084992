"""What can be read and written, by format, and conversions that give an error column in place of a failing job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import media

#: Kinds of error: bytes of no known kind, kinds without a decoder or encoder, bytes that don't decode.
UNKNOWN, NO_DECODER, NO_ENCODER, BROKEN = "unknown_format", "no_decoder", "no_encoder", "broken"


@dataclass(frozen=True)
class Codec:
    """A format's functions on one file; rasters are (width, height, RGBA)."""

    decode: Callable[[bytes], media.Image] | None = None
    encode: Callable[[int, int, bytes], bytes] | None = None


CODECS = {name: Codec(media.DECODERS.get(name), media.ENCODERS.get(name)) for name in sorted({*media.DECODERS, *media.ENCODERS})}


def capabilities() -> list[tuple[str, bool, bool]]:
    """(format, can be read, can be written)."""
    return [(name, c.decode is not None, c.encode is not None) for name, c in CODECS.items()]


class _Failed(Exception):
    """An error of a kind."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def _opened(fmt: str | None, content: bytes | None) -> media.Image:
    if not fmt:
        raise _Failed(UNKNOWN, "the first bytes are of no known format")
    decode = CODECS[fmt].decode if fmt in CODECS else None
    if not decode:
        raise _Failed(NO_DECODER, f"{fmt} can't be read")
    try:
        width, height, data = decode(content or b"")
    except Exception as error:  # whatever a broken file leads to
        raise _Failed(BROKEN, f"{type(error).__name__}: {error}") from error
    if width < 1 or height < 1 or len(data) != width * height * 4:
        raise _Failed(BROKEN, f"{len(data)} bytes for {width} by {height} pixels")
    return width, height, data


def _rows(files: DataFrame, run: Callable[[str | None, bytes | None], tuple], fields: tuple[tuple[str, str, pa.DataType], ...]) -> DataFrame:
    """media_id, success, error_kind, error and the fields that run gives, nulls where it fails."""

    def one(fmt: str | None, content: bytes | None) -> tuple:
        try:
            return True, None, None, *run(fmt, content)
        except _Failed as failed:
            return False, failed.kind, str(failed)[:200], *[None] * len(fields)

    every = (("success", "boolean", pa.bool_()), ("error_kind", "string", pa.string()), ("error", "string", pa.string()), *fields)
    schema = T.StructType(list(files.select("media_id").schema.fields))
    for name, kind, _ in every:
        schema = schema.add(name, kind)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            out = [one(f, c.as_py()) for f, c in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], t) for i, (_, _, t) in enumerate(every))], ["media_id", *(n for n, _, _ in every)])

    return files.select("media_id", "format", "content").mapInArrow(batches, schema)


def convert(files: DataFrame, to: str) -> DataFrame:
    """media_id, success, error_kind, error, format, content: each of files (media_id, format, content) in the format to, or why it isn't."""
    encode = CODECS[to].encode if to in CODECS else None

    def run(fmt: str | None, content: bytes | None) -> tuple:
        image = _opened(fmt, content)
        if not encode:
            raise _Failed(NO_ENCODER, f"{to} can't be written")
        return to, encode(*image)

    return _rows(files, run, (("format", "string", pa.string()), ("content", "binary", pa.binary())))


def show_info(files: DataFrame) -> DataFrame:
    """media_id, success, error_kind, error, width, height, opaque, length: what each of files (media_id, format, content) holds, or why that can't be told."""

    def run(fmt: str | None, content: bytes | None) -> tuple:
        width, height, data = _opened(fmt, content)
        return width, height, data[3::4].count(255) == width * height, len(content or b"")

    return _rows(files, run, (("width", "integer", pa.int32()), ("height", "integer", pa.int32()), ("opaque", "boolean", pa.bool_()), ("length", "long", pa.int64())))
