"""MPEG transport streams: packets, program tables and units, from files that are cut into ranges of bytes anywhere.

A reader of such a stream stands on a sync byte and goes on by a packet, or looks for the next sync byte. Where it stands at
the start of a range follows from the bytes before, so each range first gives where it leaves the reader for each of the
places at which it can find it; composing these along a file says how each range is entered, and the packets are then the
same wherever the file is cut. Units are numbered by the starts of each stream in a range and in those before it, so no
window holds all packets of a stream.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Length of a packet, its sync byte, stream types of pictures and of sound.
PACKET, SYNC = 188, 0x47
VIDEO, AUDIO = (0x01, 0x02, 0x1B, 0x24, 0x1C, 0x21), (0x03, 0x04, 0x0F, 0x11, 0x81)
#: Ticks of the clock reference in a second, and where it starts again.
CLOCK, WRAP = 27_000_000, 300 * 2**33
#: Bytes of ranges that are looked at together.
PORTION = 16 << 20


def _next(data: np.ndarray, n: int, at: int) -> tuple[np.ndarray, int]:
    """The packets from at on as far as they follow each other and start before n, and where the reader stands then."""
    run = data[at:n:PACKET] == SYNC
    fit = max(0, (len(data) - at) // PACKET)
    run = run[:fit]
    count = int(run.argmin()) if len(run) and not run.all() else len(run)
    return at + PACKET * np.arange(count), at + PACKET * count


def _scan(data: np.ndarray, n: int, at: int) -> tuple[list[np.ndarray], int]:
    """All packets that start before n for a reader at at, and how far behind n it ends; 0 where the file ends. One reader's walk, which tests hold _Steps against."""
    found: list[np.ndarray] = []
    sync = None
    while at < n:
        run, at = _next(data, n, at)
        if len(run):
            found.append(run)
            continue
        if data[at] != SYNC:
            sync = np.flatnonzero(data[:n] == SYNC) if sync is None else sync
            k = int(np.searchsorted(sync, at))
            at = int(sync[k]) if k < len(sync) else n
        if at < n and at + PACKET > len(data):
            return found, 0
    return found, at - n


class _Steps:
    """The steps of readers in a batch of ranges: each sync byte of a range, and where a reader that stands there stands next.

    data holds the ranges' bytes one behind the other, begins where each starts and, last, where they end; sizes are without the
    overlap. sync: places of sync bytes in data, of: their ranges, whole: whether a packet fits, to: the sync byte that comes
    next (itself, if none in the range), left: where the range is left from there, in bytes behind its end.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        self.data, self.begins, self.sizes = data, begins, sizes
        sync = np.flatnonzero(data == SYNC)
        of = np.searchsorted(begins, sync, "right") - 1
        own = sync - begins[of] < sizes[of]
        self.sync, self.of = sync[own], of[own]
        stop, behind = (begins[:-1] + sizes)[self.of], self.sync + PACKET
        self.whole = behind <= begins[1:][self.of]
        to = self.next(self.of, behind)
        ends = ~self.whole | (behind >= stop) | (to < 0)
        # Behind the last whole packet nothing follows.
        self.left = np.where(self.whole & (behind >= stop), behind - stop, 0)
        self.to = np.where(ends, np.arange(len(to)), to)

    def next(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first sync byte from at on in the range, -1 if none."""
        k = np.searchsorted(self.sync, at)
        inside = k < len(self.sync)
        inside[inside] = self.of[k[inside]] == of[inside]
        return np.where(inside, k, -1)

    def leaves(self) -> np.ndarray:
        """Where the range is left by a reader on each sync byte."""
        to = self.to
        while (to[to] != to).any():
            to = to[to]
        return self.left[to]

    def packets(self, entries: np.ndarray) -> np.ndarray:
        """The sync bytes at which packets begin for readers that enter the ranges there."""
        first = self.next(np.arange(len(entries)), self.begins[:-1] + entries)
        first = first[(first >= 0) & (entries < self.sizes)]
        met, to = np.zeros(len(self.sync), dtype=bool), self.to
        met[first] = True
        # After k rounds a step is 2 ** k steps long, and the steps up to there are met.
        while True:
            met[to[met]] = True
            if (to[to] == to).all():
                break
            to = to[to]
        return np.flatnonzero(met & self.whole)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches whose last column is the content of ranges, its bytes, and where each range begins in them; about PORTION bytes, or one range."""
    for b in batches:
        content = b.column(b.num_columns - 1).cast(pa.large_binary())
        begins = np.frombuffer(content.buffers()[1], dtype=np.int64)[content.offset : content.offset + len(content) + 1] if len(content) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < len(content):
            to = max(at + 1, int(np.searchsorted(begins, begins[at] + PORTION, "right")) - 1)
            data = np.frombuffer(content.buffers()[2] or b"", dtype=np.uint8)[begins[at] : begins[to]]
            yield b.slice(at, to - at), data, begins[at : to + 1] - begins[at]
            at = to


def _breaks(steps: _Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all ranges: how many breaks each has, the breaks, and where a reader leaves that enters up to a break and behind the one before it; entries behind a range's end are not in them."""
    n, left = len(steps.sizes), steps.leaves()
    head = np.flatnonzero(steps.sync - steps.begins[steps.of] < PACKET)
    rest = steps.next(np.arange(n), steps.begins[:-1] + PACKET)
    counts = np.bincount(steps.of[head], minlength=n) + 1
    last = np.cumsum(counts) - 1
    upto, leave = np.empty(len(head) + n, dtype=np.int16), np.empty(len(head) + n, dtype=np.int16)
    place = np.arange(len(head)) + steps.of[head]
    upto[place], leave[place] = steps.sync[head] - steps.begins[steps.of[head]], left[head]
    upto[last], leave[last] = PACKET, np.where(rest >= 0, left[rest] if len(left) else 0, 0)
    return counts, upto, leave


def leaves(data: np.ndarray, n: int) -> list[int]:
    """Where the reader stands behind the n bytes of a range, for each place from 0 to PACKET - 1 at which it enters; data holds PACKET bytes more, or ends with the file."""
    _, upto, leave = _breaks(_Steps(data, np.array([0, len(data)]), np.array([n])))
    return [_left_from(at, n, upto, leave) for at in range(PACKET)]


def _left_from(at: int, size: int, upto, leave) -> int:
    return at - size if at >= size else int(leave[bisect_left(upto, at)])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, begins in _portions(batches):
        counts, upto, leave = _breaks(_Steps(data, begins, b.column(2).to_numpy()))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int16())) for v in (upto, leave)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists], ["media_id", "start", "size", "upto", "leave"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """media_id, start, entry: where the reader stands at the start of each range; the ranges of a file come one after the other, by start."""
    file, at = None, 0
    for b in batches:
        out = []
        for media, start, size, upto, leave in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if start == 0 or media != file:
                file, at = media, 0
            out.append(at)
            at = _left_from(at, size, upto, leave)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], ["media_id", "start", "entry"])


def _stamp(raw: bytes, at: int) -> int:
    """33 bits of a time in five bytes, between marks."""
    a, b, c = struct.unpack_from(">BHH", raw, at)
    return (a >> 1 & 7) << 30 | b >> 1 << 15 | c >> 1


_FIELDS = (("at", "long"), ("pid", "integer"), ("starts", "boolean"), ("counter", "integer"), ("error", "boolean"), ("scrambled", "integer"), ("discontinuity", "boolean"), ("random_access", "boolean"), ("pcr", "long"), ("opcr", "long"), ("payload", "binary"), ("range", "long"), ("starts_in_range", "long"))
_ARROW = {"long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _packets_at(data: np.ndarray, at: np.ndarray) -> list[np.ndarray | list]:
    """pid to payload of the packets that begin at those places in data; clocks and payloads as lists with None."""
    one, two, three, four, five = (data[at + k].astype(np.int64) for k in range(1, 6))
    extra = three & 0x20 != 0
    size = np.where(extra, four, 0)
    flags = np.where(extra & (size > 0), five, 0)
    place, clocks = np.full(len(at), 6), []
    for bit in (0x10, 0x08):
        has = (flags & bit != 0) & (place + 6 <= np.minimum(5 + size, PACKET))
        a, b, c, d, e, f = (data[at[has] + place[has] + k].astype(np.int64) for k in range(6))
        value = np.zeros(len(at), dtype=np.int64)
        value[has] = ((a << 24 | b << 16 | c << 8 | d) << 1 | e >> 7) * 300 + ((e & 1) << 8 | f)
        clocks.append(pa.array(value, pa.int64(), mask=~has))
        place = place + 6 * has
    begin = np.where(extra, 5 + size, 4)
    holds = (three & 0x10 != 0) & (begin < PACKET)
    raw = data.tobytes()
    payload = [raw[p + k : p + PACKET] if h else None for p, k, h in zip(at.tolist(), begin.tolist(), holds.tolist(), strict=True)]
    return [(one & 0x1F) << 8 | two, one & 0x40 != 0, three & 15, one & 0x80 != 0, three >> 6, flags & 0x80 != 0, flags & 0x40 != 0, *clocks, payload]


def _packet(raw: bytes) -> tuple:
    """pid to payload of a packet."""
    return tuple(v[0].as_py() if isinstance(v, pa.Array) else v[0] if isinstance(v, list) else v[0].item() for v in _packets_at(np.frombuffer(raw, dtype=np.uint8), np.zeros(1, dtype=np.int64)))


def _begun(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many starts there have been up to each row, among the rows with its key."""
    order = np.argsort(keys, kind="stable")
    sums, ranked = np.cumsum(starts[order]), keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    before = sums[first] - starts[order][first]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = sums - np.repeat(before, np.diff(np.append(first, len(keys))))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, begins in _portions(batches):
        start = b.column(1).to_numpy()
        steps = _Steps(data, begins, b.column(2).to_numpy())
        found = steps.packets(b.column(3).to_numpy())
        at, of = steps.sync[found], steps.of[found]
        pid, starts, *rest = _packets_at(data, at)
        # A start without payload starts nothing.
        held = np.array([p is not None for p in rest[-1]], dtype=bool)
        columns = [start[of] + at - begins[of], pid, starts, *rest, start[of], _begun(of << 13 | pid, (starts & held).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *(c if isinstance(c, pa.Array) else pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, _FIELDS, strict=True))], ["media_id", *(n for n, _ in _FIELDS)])


def packets(ranges: DataFrame) -> DataFrame:
    """media_id, at (offset in the file), pid, starts, counter, error, scrambled, discontinuity, random_access, pcr, opcr (27 MHz), payload, range, starts_in_range: a row for each packet.

    ranges are those of byte_ranges with an overlap of PACKET. range and starts_in_range (unit starts of the pid in that range
    so far) serve to number units.
    """
    # Both passes read the ranges as they are dealt here, made and shuffled once: the condition is the join's own, which Spark would put before one of them only.
    dealt = ranges.where("media_id IS NOT NULL AND start IS NOT NULL").select("media_id", "start", "size", "content").repartition("media_id", "start")
    media = dealt.select("media_id").schema
    left = dealt.mapInArrow(_left, _typed(media, ("start", "long"), ("size", "long"), ("upto", "array<smallint>"), ("leave", "array<smallint>")))
    entries = left.repartition("media_id").sortWithinPartitions("media_id", "start").mapInArrow(_composed, _typed(media, ("start", "long"), ("entry", "integer")))
    entered = dealt.join(entries, ["media_id", "start"]).select("media_id", "start", "size", "entry", "content")
    return entered.mapInArrow(_parsed, _typed(media, *_FIELDS))


def _typed(schema, *fields):
    from pyspark.sql import types as T

    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        out = out.add(name, T.ArrayType(T.ShortType()) if kind.startswith("array") else kind)
    return out


# --- program tables ---


_REVERSED = bytes(int(f"{v:08b}"[::-1], 2) for v in range(256))


def crc32_mpeg(data: bytes) -> int:
    """The checksum of program tables: of a section with its own, 0. It is that of zlib with the bits of each byte, and of the result, the other way round."""
    return int.from_bytes((zlib.crc32(data.translate(_REVERSED)) ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_REVERSED), "big")


def _section(payload: bytes, table: int) -> bytes | None:
    """The section of that table at the start of a payload, if it is whole and its checksum holds."""
    at = 1 + payload[0] if payload else 0
    raw = payload[at : at + 3 + (int.from_bytes(payload[at + 1 : at + 3], "big") & 0xFFF)]
    whole = len(raw) >= 12 and raw[0] == table and len(raw) == 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    return raw if whole and crc32_mpeg(raw) == 0 else None


def _programs(payload: bytes) -> Iterator[tuple[int, int]]:
    raw = _section(payload, 0) or b""
    for at in range(8, len(raw) - 7, 4):
        number, pid = struct.unpack_from(">HH", raw, at)
        if number:
            yield number, pid & 0x1FFF


def _streams(payload: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    raw = _section(payload, 2) or b""
    if not raw:
        return
    program, clock = struct.unpack_from(">H", raw, 3)[0], struct.unpack_from(">H", raw, 8)[0] & 0x1FFF
    at, place = 12 + (struct.unpack_from(">H", raw, 10)[0] & 0xFFF), 0
    while at + 5 <= len(raw) - 4:
        kind, pid, more = struct.unpack_from(">BHH", raw, at)
        yield program, clock, place, kind, pid & 0x1FFF
        at, place = at + 5 + (more & 0xFFF), place + 1


def _read_tables(rows: DataFrame, parse, names: tuple[str, ...]) -> DataFrame:
    """media_id, at and the numbers that parse gives for the payloads of rows (media_id, at, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *f) for i, p in enumerate(b.column(2).to_pylist()) for f in parse(p or b"")]
            take = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array([f[k + 1] for f in found], pa.int32()) for k in range(len(names)))], ["media_id", "at", *names])

    return rows.select("media_id", "at", "payload").mapInArrow(run, _typed(rows.select("media_id").schema, ("at", "long"), *((n, "integer") for n in names)))


def programs(packets: DataFrame) -> DataFrame:
    """media_id, at, program, pmt_pid: each program with where a table first names it; tables with a wrong checksum don't count."""
    found = _read_tables(packets.where("pid = 0 AND starts AND payload IS NOT NULL"), _programs, ("program", "pmt_pid"))
    return found.groupBy("media_id", "program", "pmt_pid").agg(F.min("at").alias("at")).select("media_id", "at", "program", "pmt_pid")


_TABLE_FIELDS = ("pid", "program", "pcr_pid", "place", "stream_type", "stream")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each program that a table names, with the map's pid and no stream, and for each stream of a map, with the pid the map came by."""
    for b in batches:
        out = []
        for i, (pid, payload) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            if pid == 0:
                out += [(i, named, program, None, None, None, None) for program, named in _programs(payload)]
            out += [(i, pid, program, clock, place, kind, stream) for program, clock, place, kind, stream in _streams(payload)]
        take = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array([o[k + 1] for o in out], pa.int32()) for k in range(len(_TABLE_FIELDS)))], ["media_id", "at", *_TABLE_FIELDS])


def _first_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of _tables, a file's one after the other and by at: those of its first map that comes by a pid named before."""
    file, first, named = None, None, {}
    for b in batches:
        keep = []
        for i, (media, at, pid, stream) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, b.num_columns - 1)), strict=True)):
            if media != file:
                file, first, named = media, None, {}
            if stream is None:
                named.setdefault(pid, at)
            elif at == first or first is None and named.get(pid, at) < at:
                first = at
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def streams(packets: DataFrame) -> DataFrame:
    """media_id, at, program, pcr_pid, place, stream_type, pid, kind (video, audio or null): the streams of the first map of a program that is named before it."""
    # Programs and maps are read in one pass; a map's section begins with its type, behind the bytes that the first one counts.
    skipped = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int")
    may_hold = packets.where("starts AND payload IS NOT NULL").where((F.col("pid") == 0) | (F.hex(F.substring(F.col("payload"), skipped + 2, F.lit(1))) == "02"))
    rows = may_hold.select("media_id", "at", "pid", "payload")
    found = rows.mapInArrow(_tables, _typed(rows.select("media_id").schema, ("at", "long"), *((n, "integer") for n in _TABLE_FIELDS)))
    first = found.repartition("media_id").sortWithinPartitions("media_id", "at").mapInArrow(_first_maps, found.schema)
    kind = F.when(F.col("stream_type").isin(*VIDEO), "video").when(F.col("stream_type").isin(*AUDIO), "audio")
    return first.select("media_id", "at", "program", "pcr_pid", "place", "stream_type", F.col("stream").alias("pid"), kind.alias("kind"))


# --- units ---


def _opened_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stream_id, pts, dts and the data of units; what doesn't start as a unit does is left out."""
    for b in batches:
        out = []
        for i, raw in enumerate(b.column(b.num_columns - 1).to_pylist()):
            if len(raw) < 9 or raw[:3] != b"\0\0\1" or raw[3] < 0xBC:
                continue
            at, stamps = 9, []
            for bit in (0x80, 0x40):
                here = raw[7] & bit and at + 5 <= len(raw)
                stamps.append(_stamp(raw, at) if here else None)
                at += 5 if here else 0
            if len(raw) > 9 + raw[8]:
                out.append((i, raw[3], *stamps, raw[9 + raw[8] :]))
        take = pa.array([o[0] for o in out], pa.int64())
        kept = [b.column(i).take(take) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array([o[k] for o in out], t) for k, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.binary())))], [*b.schema.names[:-1], "stream_id", "pts", "dts", "data"])


def units(packets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """media_id, pid, kind, at, stream_id, pts, dts (90 kHz), data: the units of the last video and the last audio stream, in the order of at.

    A unit begins at a packet that starts one, after the program's map, and holds the stream's payloads up to the next start
    or the end of the file; units without data and starts without a header are left out. of: streams(packets), if at hand.
    """
    known = (streams(packets) if of is None else of).where("kind IS NOT NULL")
    last = known.groupBy("media_id", "kind").agg(F.max_by("pid", "place").alias("pid"), F.max("at").alias("known_at"))
    keys = ["media_id", "pid"]
    light = packets.select(*keys, "range", "starts_in_range").groupBy(*keys, "range").agg(F.max("starts_in_range").alias("n"))
    before = light.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    # What is known of a stream in a range is light; the payloads are joined with it once.
    known_of = before.drop("n").join(last, keys)
    own = packets.where("payload IS NOT NULL").join(known_of, [*keys, "range"]).where("at > known_at")
    numbered = own.withColumn("unit", F.col("before") + F.col("starts_in_range"))
    parts = F.array_sort(F.collect_list(F.struct("at", "starts", "payload")))
    whole = numbered.groupBy(*keys, "kind", "unit").agg(parts.alias("parts")).where("parts[0].starts")
    raw = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), ""))
    given = whole.select(*keys, "kind", F.col("parts")[0]["at"].alias("at"), raw.alias("raw"))
    schema = _typed(given.drop("raw").schema, ("stream_id", "integer"), ("pts", "long"), ("dts", "long"), ("data", "binary"))
    return given.mapInArrow(_opened_units, schema)


def duration(packets: DataFrame, per_second: int = CLOCK) -> DataFrame:
    """media_id, first_pcr, last_pcr, seconds (double): from the first to the last clock reference of a file with two of them; a clock that has started again once counts on."""
    found = packets.where("pcr IS NOT NULL").groupBy("media_id").agg(F.min_by("pcr", "at").alias("first_pcr"), F.max_by("pcr", "at").alias("last_pcr"), F.count(F.lit(1)).alias("n"))
    span = F.col("last_pcr") - F.col("first_pcr")
    return found.where("n > 1").select("media_id", "first_pcr", "last_pcr", ((span + F.when(span < 0, WRAP).otherwise(0)) / per_second).alias("seconds"))
