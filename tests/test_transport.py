"""Transport streams cut anywhere, against a reader that walks the whole file; byte ranges of files."""

import random

import numpy as np
import pytest

from rasterflow.sources import byte_ranges, transport

PACKET = transport.PACKET


def walked(raw):
    """Offsets of the packets of a reader that goes from the start to the end."""
    at, out = 0, []
    while at + PACKET <= len(raw):
        if raw[at] == 0x47:
            out.append(at)
            at += PACKET
        else:
            at += 1
    return out


def noisy(seed, n=60):
    """Packets with sync bytes all over, and junk with and without them in between."""
    r = random.Random(seed)
    out = b""
    for _ in range(n):
        if r.random() < 0.2:
            out += bytes(r.choice((0x47, r.randrange(256))) for _ in range(r.randrange(300)))
        out += bytes([0x47, r.randrange(256), r.randrange(256), r.randrange(256)]) + bytes(r.choice((0x47, r.randrange(256))) for _ in range(184))
    return out + bytes(r.randrange(256) for _ in range(r.randrange(200)))


@pytest.mark.parametrize("size", [1, 50, 187, 188, 189, 1000, 4096, 10**6])
def test_packets_do_not_depend_on_cuts(size):
    for seed in range(4):
        raw = noisy(seed) if seed else b"\x47" * 5000
        data = np.frombuffer(raw, dtype=np.uint8)
        at, found = 0, []
        for start in range(0, len(raw), size):
            own = data[start : start + size + PACKET]
            n = min(size, len(raw) - start)
            found += [start + int(x) for run in transport._scan(own, n, at)[0] for x in run]
            left = transport.leaves(own, n)
            assert len(left) == PACKET and left[at] == transport._scan(own, n, at)[1]
            at = left[at]
        assert found == walked(raw)


def test_leaves_of_all_entries():
    data = np.frombuffer(noisy(9, 20), dtype=np.uint8)
    for n in (0, 100, 700, len(data) - 100, len(data)):
        own = data[: n + PACKET]
        assert transport.leaves(own, n) == [transport._scan(own, n, c)[1] for c in range(PACKET)]


def packet(pid, payload, starts=False, counter=0, clock=None):
    room = 184 - len(payload)
    extra = b""
    if clock is not None or room:
        flags = 0x10 if clock is not None else 0
        base, ext = divmod(clock or 0, 300)
        body = (base >> 1).to_bytes(4, "big") + bytes([(base & 1) << 7 | 0x7E | ext >> 8, ext & 255]) if flags else b""
        extra = (bytes([flags]) + body).ljust(room - 1, b"\xff")[: max(room - 1, 0)] if room > 1 or flags else b""
        extra = bytes([len(extra)]) + extra
    return bytes([0x47, (0x40 if starts else 0) | pid >> 8, pid & 255, (0x30 if extra else 0x10) | counter]) + extra + payload


def table(pid, body, wrong=False):
    section = body + (transport.crc32_mpeg(body) ^ wrong).to_bytes(4, "big")
    return packet(pid, (b"\0" + section).ljust(184, b"\xff"), True)


def pat(*programs, wrong=False):
    rows = b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in programs)
    return table(0, b"\0\xb0" + bytes([9 + len(rows)]) + b"\0\1\xc1\0\0" + rows, wrong)


def pmt(pid, program, *streams, wrong=False):
    rows = b"".join(bytes([kind]) + (0xE000 | s).to_bytes(2, "big") + b"\xf0\2\xaa\xbb" for kind, s in streams)
    return table(pid, b"\2\xb0" + bytes([13 + len(rows)]) + program.to_bytes(2, "big") + b"\xc1\0\0\xe1\2\xf0\0" + rows, wrong)


def pes(data, pts=None, dts=None, stream=0xE0):
    mark = lambda t, m: bytes([m | t >> 29 & 14 | 1]) + (t >> 15 << 1 & 0xFFFE | 1).to_bytes(2, "big") + (t << 1 & 0xFFFE | 1).to_bytes(2, "big")
    times = (mark(pts, 0x20) if pts is not None else b"") + (mark(dts, 0x10) if dts is not None else b"")
    return b"\0\0\1" + bytes([stream]) + b"\0\0\x80" + bytes([(pts is not None) << 7 | (dts is not None) << 6, len(times)]) + times + data


PARTS = [
    packet(0x100, pes(b"before any table"), True),
    pmt(0x20, 1, (0x1B, 0x100)),  # before its program is named
    pat((1, 0x21), wrong=True),
    pat((0, 0x10), (1, 0x20), (2, 0x30)),
    pmt(0x20, 1, (0x1B, 0x100), wrong=True),
    packet(0x100, pes(b"still before"), True),
    pmt(0x20, 1, (0x02, 0x99), (0x1B, 0x100), (0x0F, 0x101), (0x06, 0x103)),
    pmt(0x30, 2, (0x1B, 0x200)),
    packet(0x100, b"tail of a unit that began before"),
    packet(0x100, pes(b"one ", pts=2**33 - 1, dts=5), True, clock=2**33 * 300 - 300),
    packet(0x101, pes(b"sound", stream=0xC0), True),
    packet(0x100, b"two "),
    packet(0x103, pes(b"private"), True),
    packet(0x99, pes(b"not the last video"), True),
    packet(0x200, pes(b"other program"), True),
    packet(0x100, b"three"),
    packet(0x100, b"no header here at all", True),
    packet(0x100, b"lost"),
    packet(0x100, pes(b""), True),
    packet(0x101, b" goes on"),
    packet(0x100, pes(b"last", pts=7), True, clock=27_000_000 - 300),
]


@pytest.mark.parametrize("size", [100, 188, 1000, 10**6])
def test_units(spark, tmp_path, size):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.ts").write_bytes(b"junk" + b"xx".join(PARTS))
    (tmp_path / "deep" / "b.ts").write_bytes(b"".join(PARTS[9:]))
    (tmp_path / "empty.ts").write_bytes(b"")
    spark.dataSource.register(byte_ranges.ByteRanges)
    ranges = spark.read.format("byte_ranges").option("size", size).option("overlap", PACKET).load(str(tmp_path))
    found = transport.packets(ranges)
    assert found.groupBy("media_id").count().count() == 2 and found.count() == len(PARTS) * 2 - 9
    got = [(r.media_id[-4:], r.kind, r.stream_id, r.pts, r.dts, bytes(r.data)) for r in transport.units(found).orderBy("pid", "at").collect()]
    assert got == [("a.ts", "video", 0xE0, 2**33 - 1, 5, b"one two three"), ("a.ts", "video", 0xE0, 7, None, b"last"), ("a.ts", "audio", 0xC0, None, None, b"sound goes on")]
    assert [(r.program, r.pcr_pid, r.place, r.stream_type, r.pid, r.kind) for r in transport.streams(found).orderBy("place").collect()] == [(1, 0x102, 0, 2, 0x99, "video"), (1, 0x102, 1, 0x1B, 0x100, "video"), (1, 0x102, 2, 0x0F, 0x101, "audio"), (1, 0x102, 3, 6, 0x103, None)]
    assert {(r.first_pcr, r.last_pcr, r.seconds) for r in transport.duration(found).collect()} == {(2**33 * 300 - 300, 27_000_000 - 300, 1.0)}


def test_checksum_and_broken_tables():
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7
    whole = pat((1, 0x20))[4:]
    assert list(transport._programs(whole)) == [(1, 0x20)]
    for cut in range(17):
        assert list(transport._programs(whole[:cut])) == [] and list(transport._streams(whole[:cut])) == []


def test_adaptation_of_all_sizes():
    for flags in range(256):
        for size in (0, 1, 6, 7, 13, 182, 183, 255):
            fields = transport._packet(bytes([0x47, 0, 1, 0x30, size, flags]) + bytes(182))
            assert fields[0] == 1 and (fields[-1] is None or len(fields[-1]) == 183 - size)


def test_ranges_of_columns(spark):
    media = spark.createDataFrame([(1, b"0123456789"), (2, b""), (3, None), (4, b"x")], "media_id int, content binary")
    got = [(r.media_id, r.start, r.size, r.length, bytes(r.content)) for r in byte_ranges.ranges_of(media, 4, 3).orderBy("media_id", "start").collect()]
    assert got == [(1, 0, 4, 10, b"0123456"), (1, 4, 4, 10, b"456789"), (1, 8, 2, 10, b"89"), (4, 0, 1, 1, b"x")]
