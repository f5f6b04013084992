"""Streams that are stopped and started again give what a batch gives."""

import datetime as dt
import random

import pytest

from rasterflow.streaming import media_stream, stateful

START = dt.datetime(2024, 1, 1)
PACKETS = "media_id string, pid int, at long, starts boolean, payload binary, ts timestamp"


def rows(seed, n=300):
    r = random.Random(seed)
    return [(f"m{r.randrange(3)}", r.randrange(2), i, r.random() < 0.2, f"<{i}>".encode() if r.random() < 0.95 else None, START + dt.timedelta(seconds=i)) for i in range(n)]


def units(packets, closed_before=None):
    """Units in plain Python; closed_before: streams without packets since then end."""
    open_, out, last = {}, [], {}
    for media, pid, at, starts, payload, ts in packets:
        key = media, pid
        last[key] = ts
        if starts:
            out += [(*key, *open_.pop(key))] if key in open_ else []
            open_[key] = (at, 0, b"")
        if key in open_:
            first, n, held = open_[key]
            open_[key] = first, n + 1, held + (payload or b"")
    return sorted(out + [(*k, *u) for k, u in open_.items() if closed_before and last[k] < closed_before])


def written(spark, path, batch, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/batch={batch:03d}")


def source(spark, path, schema):
    return spark.readStream.schema(schema + ", batch int").option("maxFilesPerTrigger", 1).parquet(str(path)).drop("batch")


def test_units_survive_a_restart(spark, tmp_path):
    data = rows(1)
    folder = tmp_path / "in"
    cuts = [0, 40, 41, 100, 180, 250, 300]
    for k in range(3):
        written(spark, folder, k, random.Random(k).sample(data[cuts[k] : cuts[k + 1]], cuts[k + 1] - cuts[k]), PACKETS)
    where = {"checkpoint": str(tmp_path / "checkpoint"), "folder": str(tmp_path / "out")}
    run = lambda: stateful.run_to_end(stateful.stream_units(source(spark, folder, PACKETS)), "units", **where)
    got = lambda df: sorted((r.media_id, r.pid, r.at, r.packets, bytes(r.payload)) for r in df.collect())
    assert got(run()) == units(data[:100])
    for k in range(3, 6):
        written(spark, folder, k, data[cuts[k] : cuts[k + 1]], PACKETS)
    # Stopped in the middle of its batches, and started again.
    query = stateful.stream_units(source(spark, folder, PACKETS)).writeStream.format("parquet").option("checkpointLocation", where["checkpoint"]).option("path", where["folder"]).start()
    query.stop()
    assert got(run()) == units(data)
    # Long after, the open units end.
    later = START + dt.timedelta(hours=2)
    written(spark, folder, 9, [("other", 9, 1000, False, b"x", later)], PACKETS)
    assert got(run()) == units(data, later)


def playlist(first, n):
    return f"#EXTM3U\n#EXT-X-TARGETDURATION:4\n#EXT-X-MEDIA-SEQUENCE:{first}\n" + "".join(f"#EXTINF:{i % 4 + 0.5},\ns{i}.ts\n" for i in range(first, first + n))


def test_only_new_segments_come_out(spark, tmp_path):
    schema, folder = "media_id long, ts timestamp, text string", tmp_path / "in"
    polls = [(k % 2, START + dt.timedelta(seconds=10 * k), playlist(3 * (k // 2), 5)) for k in range(12)]
    polls += [(0, START + dt.timedelta(seconds=121), None), (0, START + dt.timedelta(seconds=122), playlist(2, 4)), (1, START + dt.timedelta(seconds=123), "no playlist tags\n")]
    for k in range(3):
        written(spark, folder, k, polls[5 * k : 5 * k + 5], schema)
    where = {"checkpoint": str(tmp_path / "checkpoint"), "folder": str(tmp_path / "out")}
    run = lambda: stateful.run_to_end(stateful.new_segments(source(spark, folder, schema)), "segments", **where)
    rows_ = lambda: sorted((r.media_id, r.sequence, r.uri, r.seconds) for r in run().collect())
    want = sorted((m, i, f"s{i}.ts", i % 4 + 0.5) for m in (0, 1) for i in range(20))
    assert rows_() == want
    written(spark, folder, 3, [(0, START + dt.timedelta(seconds=130), playlist(18, 5))], schema)
    assert rows_() == sorted(want + [(0, i, f"s{i}.ts", i % 4 + 0.5) for i in (20, 21, 22)])


def test_playlist_segments():
    assert stateful.playlist_segments(None) == [] and stateful.playlist_segments("") == []
    assert stateful.playlist_segments("#EXTM3U\r\n#EXTINF:x,\r\na\r\nb\r\n#EXT-X-MEDIA-SEQUENCE:7\r\n") == [(0, "a", 0.0), (1, "b", 0.0)]


@pytest.mark.parametrize("operator", [media_stream.sessions, media_stream.windowed_counts])
def test_windows_over_a_stream(spark, tmp_path, operator):
    """Restarted, the stream gives the windows that have ended, as the batch has them."""
    schema, folder = "user_id long, event_type string, value double, ts timestamp", tmp_path / "in"
    r = random.Random(2)
    data = [(r.randrange(5), r.choice("ab"), float(k), START + dt.timedelta(minutes=7 * k)) for k in range(600)]
    where = {"checkpoint": str(tmp_path / "checkpoint"), "folder": str(tmp_path / "out")}
    for k in range(3):
        written(spark, folder, k, data[200 * k : 200 * k + 200], schema)
        got = stateful.run_to_end(operator(source(spark, folder, schema)), "windows", **where)
    batch = operator(spark.createDataFrame(data, schema))
    length = dt.timedelta(0) if "session_end" in batch.columns else dt.timedelta(days=1)
    ends = batch.columns.index("session_end" if "session_end" in batch.columns else "window_start")
    limit = START + dt.timedelta(minutes=7 * 599) - dt.timedelta(hours=1)
    # Filtered here: a filter on the end of sessions would reach the events before they are put together.
    assert sorted(map(tuple, got.collect())) == sorted(r for r in map(tuple, batch.collect()) if r[ends] + length <= limit)
    assert 0 < got.count() < batch.count()


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = {"checkpoint": str(tmp_path / "checkpoint"), "folder": str(tmp_path / "out")}
    run = lambda: {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in stateful.run_to_end(media_stream.watch_folder(spark, str(tmp_path / "in"), "*.bin"), "watched", **where).collect()}
    (tmp_path / "in" / "a.bin").write_bytes(b"a")
    (tmp_path / "in" / "a.txt").write_bytes(b"no")
    assert run() == {"a.bin": b"a"}
    (tmp_path / "in" / "b.bin").write_bytes(b"b")
    assert run() == {"a.bin": b"a", "b.bin": b"b"}
