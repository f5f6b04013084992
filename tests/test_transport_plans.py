"""Ranges of many files in one batch, and how often the queries over transport streams make and read them."""

import pyarrow as pa
import pytest
from rasterflow.plans import containers
from rasterflow.sources import transport
from tests.test_transport import PACKET, noisy, walked

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 50, 187, 188, 1000, 10**6])
@pytest.mark.parametrize("portion", [1, 700, 16 << 20])
def test_ranges_of_many_files_in_one_batch(monkeypatch, size, portion):
    monkeypatch.setattr(transport, "PORTION", portion)
    files = [b"\x47" * 900, b"", noisy(1, 9), b"no packet", noisy(2, 5), b"\x47" + noisy(3, 7)]
    rows = [(f, at, min(size, len(raw) - at), raw[at : at + size + PACKET]) for f, raw in enumerate(files) for at in range(0, len(raw), size)]
    cut = lambda rows, kinds: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [str(k) for k in range(len(kinds))])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    batches = [cut(rows[:1] + rows, kinds).slice(1), cut(rows[:0], kinds)]
    entries = [e for b in transport._composed(transport._left(iter(batches))) for e in b.column(2).to_pylist()]
    entered = cut([(f, at, n, e, raw) for (f, at, n, raw), e in zip(rows, entries, strict=True)], [*kinds[:3], pa.int32(), pa.binary()])
    found = [p for b in transport._parsed(iter([entered])) for p in b.to_pylist()]
    assert [(p["media_id"], p["at"]) for p in found] == [(f, at) for f, raw in enumerate(files) for at in walked(raw)]
    for p in found:
        own = [q for q in found if (q["media_id"], q["pid"], q["range"]) == (p["media_id"], p["pid"], p["range"]) and q["at"] <= p["at"]]
        assert p["starts_in_range"] == sum(q["starts"] and q["payload"] is not None for q in own)
        raw = files[p["media_id"]][p["at"] :][:PACKET]
        assert p["pid"] == (raw[1] & 31) << 8 | raw[2] and (p["payload"] is None or raw.endswith(p["payload"]))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_units_make_their_ranges_once(spark):
    plan = final_plan(containers.ts_units(spark, SF))
    assert plan.count("Generate explode") == 1 and plan.count("_left(") == 1


def test_durations_compose_files_without_a_call_for_each(spark):
    plan = final_plan(containers.ts_duration(spark, SF))
    assert plan.count("Generate explode") == 1 and "FlatMapGroups" not in plan


def test_streams_read_their_packets_once(spark):
    plan = final_plan(containers.ts_streams(spark, SF))
    assert plan.count("Generate explode") == 1 and plan.count("MapInArrow _parsed(") == 1


def test_first_maps_of_files_over_batches():
    names = ["media_id", "at", "pid", "stream"]
    rows = [(1, 0, 32, 256), (1, 188, 32, None), (1, 188, 48, None), (1, 376, 32, 257), (1, 376, 32, 258), (1, 564, 48, 259), (2, 0, 32, 256), (3, 0, 0, None), (3, 0, 0, 9), (3, 9, 0, 10)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True))]) if r[3] is not None else pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in r], names) for r in rows]
    assert [tuple(r.values()) for b in transport._first_maps(iter(batches)) for r in b.to_pylist()] == [rows[3], rows[4], rows[9]]
