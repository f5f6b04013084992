"""Media files as DataFrames: a binary source with types, raster and audio codecs, and a file sink.

Codecs are small row functions run in Arrow batches; what can't be decoded becomes a null with an error, or raises in
FAILFAST mode. Rasters are packed RGBA: width, height, data (4 bytes for each pixel, row by row).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import sniff
from .byte_ranges import opened

RASTER = "width int, height int, data binary"
Image = tuple[int, int, bytes]


def format_of(content: Column) -> Column:
    """The format that the first bytes tell, or null."""
    head = F.hex(F.substring(content, 1, 1000))
    # Two formats that have decoders here and that the common sniffing leaves out.
    return F.coalesce(sniff.sniff(head), F.when(head.startswith(b"P7".hex()), "pam"), F.when(head.startswith(b"farbfeld".hex().upper()), "farbfeld"))


def read_media(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """media_id (the path), length, content, format, mime for all files under path; the type tests read only the first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("media_id"), "length", "content", format_of(F.col("content")).alias("format")).withColumn("mime", sniff.mime_type(F.col("format")))


# --- rasters ---


def encode_bmp(w: int, h: int, data: bytes) -> bytes:
    """32 bits a pixel, rows from below."""
    px = np.frombuffer(data, dtype=np.uint8).reshape(h, w, 4)[::-1, :, [2, 1, 0, 3]].tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(px), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 32, 0, len(px), 2835, 2835, 0, 0) + px


def decode_bmp(raw: bytes) -> Image:
    """Uncompressed 24 and 32 bits."""
    at, (w, h, _, bits, packed) = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<iiHHI", raw, 18)
    if raw[:2] != b"BM" or bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("not a plain BMP of 24 or 32 bits")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, dtype=np.uint8, count=stride * abs(h), offset=at).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    rows = rows if h < 0 else rows[::-1]
    out = np.full((abs(h), w, 4), 255, dtype=np.uint8)
    out[:, :, :3] = rows[:, :, 2::-1]
    if bits == 32:
        out[:, :, 3] = rows[:, :, 3]
    return w, abs(h), out.tobytes()


def encode_png(w: int, h: int, data: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((h, 1 + 4 * w), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(h, 4 * w)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> Image:
    """8 bits a channel, not interlaced: gray, RGB, palette, gray with alpha, RGBA."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, palette, clear = 8, [], None, b""
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if bits != 8 or laced:
        raise ValueError("only 8 bits without interlace")
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(h, 1 + w * depth)
    px = np.zeros((h, w * depth), dtype=np.uint8)
    above = np.zeros(w * depth, dtype=np.uint8)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = line.reshape(w, depth).cumsum(axis=0).reshape(-1)
        elif kind in (3, 4):
            up, left = above.astype(np.int32), np.zeros(w * depth + depth, dtype=np.int32)
            for i in range(w * depth):
                a, b, c = left[i], up[i], up[i - depth] if i >= depth else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                left[i + depth] = (line[i] + guess) & 255
            line = left[depth:]
        above = px[y] = (line & 255).astype(np.uint8)
    px = px.reshape(h, w, depth)
    out = np.full((h, w, 4), 255, dtype=np.uint8)
    if colour == 3:
        out[:, :, :3] = palette[px[:, :, 0]]
        alpha = np.full(256, 255, dtype=np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, dtype=np.uint8)
        out[:, :, 3] = alpha[px[:, :, 0]]
    else:
        out[:, :, :3] = px[:, :, :3] if depth >= 3 else px[:, :, :1]
        if depth in (2, 4):
            out[:, :, 3] = px[:, :, -1]
    return w, h, out.tobytes()


def encode_pam(w: int, h: int, data: bytes) -> bytes:
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n".encode() + data


def decode_pnm(raw: bytes) -> Image:
    """P5 and P6 of 8 bits, and P7 of depth 4."""
    if raw[:2] == b"P7":
        head, _, body = raw.partition(b"ENDHDR\n")
        fields = dict(x.split(None, 1) for x in head.decode().splitlines()[1:] if " " in x)
        if fields.get("DEPTH") != "4":
            raise ValueError("only depth 4")
        return int(fields["WIDTH"]), int(fields["HEIGHT"]), body
    kind, w, h, _, body = raw.split(None, 4) if raw[:2] in (b"P5", b"P6") else (b"", 0, 0, 0, b"")
    w, h = int(w), int(h)
    depth = {b"P5": 1, b"P6": 3}[kind]
    body = raw[len(raw) - w * h * depth :]
    out = np.full((h, w, 4), 255, dtype=np.uint8)
    out[:, :, :3] = np.frombuffer(body, dtype=np.uint8).reshape(h, w, depth)
    return w, h, out.tobytes()


def encode_farbfeld(w: int, h: int, data: bytes) -> bytes:
    return b"farbfeld" + struct.pack(">II", w, h) + (np.frombuffer(data, dtype=np.uint8).astype(">u2") * 257).astype(">u2").tobytes()


def decode_farbfeld(raw: bytes) -> Image:
    w, h = struct.unpack_from(">II", raw, 8)
    return w, h, (np.frombuffer(raw, dtype=">u2", offset=16, count=w * h * 4) >> 8).astype(np.uint8).tobytes()


ENCODERS: dict[str, Callable[[int, int, bytes], bytes]] = {"bmp": encode_bmp, "png": encode_png, "pam": encode_pam, "farbfeld": encode_farbfeld}
DECODERS: dict[str, Callable[[bytes], Image]] = {"bmp": decode_bmp, "png": decode_png, "pnm": decode_pnm, "pbm": decode_pnm, "pgm": decode_pnm, "ppm": decode_pnm, "pam": decode_pnm, "farbfeld": decode_farbfeld}


def encode(rasters: DataFrame, fmt: str) -> DataFrame:
    """media_id, format, content from rasters (media_id, width, height, data)."""
    coder = ENCODERS[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [coder(r["width"], r["height"], bytes(r["data"])) for r in b.select(["width", "height", "data"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fmt] * len(out), pa.string()), pa.array(out, pa.binary())], ["media_id", "format", "content"])

    schema = rasters.select("media_id").schema.add("format", "string").add("content", "binary")
    return rasters.select("media_id", "width", "height", "data").mapInArrow(run, schema)


def decode(media: DataFrame, failfast: bool = False) -> DataFrame:
    """media_id, width, height, data, error from media (media_id, format, content)."""

    def one(fmt: str | None, content: bytes | None) -> tuple:
        try:
            return (*DECODERS[fmt or ""](content or b""), None)
        except Exception as e:
            if failfast:
                raise
            return None, None, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(f, c) for f, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string())))], ["media_id", "width", "height", "data", "error"])

    schema = media.select("media_id").schema.add("width", "integer").add("height", "integer").add("data", "binary").add("error", "string")
    return media.select("media_id", "format", "content").mapInArrow(run, schema)


# --- audio ---


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM from samples (frames, channels) in [-1, 1]."""
    pcm = np.clip(np.floor(samples * 32767 + 0.5), -32768, 32767).astype("<i2").tobytes()
    ch = samples.shape[1]
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, ch, rate, rate * ch * 2, ch * 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """The rate and samples (frames, channels) of 8, 16 or 32-bit PCM or 32-bit float."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<4sI", raw, at)
        if kind == b"fmt ":
            code, ch, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif kind == b"data":
            body = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if (code, bits) == (3, 32):
        out = np.frombuffer(body, dtype="<f4").astype(float)
    else:
        kind, scale = {8: ("u1", 128.0), 16: ("<i2", 32768.0), 32: ("<i4", 2147483648.0)}[bits]
        out = (np.frombuffer(body, dtype=kind).astype(float) - (128 if bits == 8 else 0)) / scale
    return rate, out.reshape(-1, ch)


# --- sink ---


def file_name(media_id: str, fmt: str) -> str:
    """A name of its own for each id and format: whatever isn't a letter, digit or one of _.-~ is spelt out by its bytes, and so is a first _ or . (readers skip such files)."""
    name = quote(media_id, safe="")
    return f"{f'%{ord(name[0]):02X}{name[1:]}' if name[:1] in ('_', '.') else name}.{quote(fmt, safe='')}"


def file_id(path: Column) -> Column:
    """The id that file_name() made the name in path from."""
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""))


class MediaSink(DataSource):
    """df.write.format("media").mode("append").save(folder): one file for each row of (media_id, format, content).

    Each attempt of a task writes into a folder of its own, and only the commit of the whole job moves files to their names, so
    a job that fails leaves none and a task that is tried again leaves each once. An id that a job writes twice, an empty
    or null id and a null content fail it. A file that is there already is replaced; mode overwrite also deletes all others. Folders lie in
    any store whose scheme Arrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return "media_id string, format string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [f.name for f in schema.fields], overwrite)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite
        self.staged = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        store, folder = opened(self.path)
        own, written = f"{folder}/{self.staged}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for row in rows:
            r = dict(zip(self.names, row, strict=True))
            if not r["media_id"] or r["content"] is None:
                raise ValueError("an id is empty, or an id or content null")
            name = file_name(str(r["media_id"]), str(r["format"]))
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write(bytes(r["content"]))
            written.append(name)
        return _Written(own, written)

    def commit(self, messages) -> None:
        store, folder = opened(self.path)
        done = [(m.folder, n) for m in messages if m is not None for n in m.names]
        twice = [n for n, count in Counter(n for _, n in done).items() if count > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows for one file: {twice[:3]}")
        if self.overwrite:
            kept = {f"{folder}/{self.staged}"}
            for info in store.get_file_info(pa.fs.FileSelector(folder)):
                if info.path not in kept:
                    (store.delete_file if info.is_file else store.delete_dir)(info.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(f"{x[0]}/{x[1]}", f"{folder}/{x[1]}"), done))
        self.abort(messages)

    def abort(self, messages) -> None:
        """Deletes what the job's attempts have left."""
        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/{self.staged}").type != pa.fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.staged}")
