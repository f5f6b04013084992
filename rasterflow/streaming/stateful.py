"""Stateful operators over streams: units put together from packets, and what is new in the polls of live playlists.

State lies in Spark's state store (RocksDB), keyed by stream or playlist, with timers in event time; after a restart from the
checkpoint a query goes on where it stood. The functions set the session's state store, which these operators need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.byte_ranges import shared_folder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(duration: str) -> int:
    """Milliseconds of a duration such as "30 minutes"."""
    n, unit = duration.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.removesuffix("s")]


def _moved(handle: StatefulProcessorHandle, to: int) -> None:
    """The key's one timer now ends at to, unless it ends later."""
    timers = list(handle.listTimers())
    if not timers or max(timers) < to:
        for t in timers:
            handle.deleteTimer(t)
        handle.registerTimer(to)


class _Units(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "at long, payload binary")

    def _closed(self, key: tuple) -> Iterator[Row]:
        held = sorted((p[0], bytes(p[1])) for p in self.parts.get())
        if held:
            self.parts.clear()
            yield Row(**dict(zip(("media_id", "pid"), key, strict=True)), at=held[0][0], packets=len(held), payload=b"".join(p for _, p in held))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        latest, fresh = 0, []
        opened = self.parts.exists()
        for r in sorted(rows, key=lambda r: r["at"]):
            latest = max(latest, int(r["ts"].timestamp() * 1000))
            if r["starts"]:
                for part in fresh:
                    self.parts.appendValue(part)
                yield from self._closed(key)
                fresh, opened = [], True
            if opened:
                fresh.append((r["at"], bytes(r["payload"] or b"")))
        for part in fresh:
            self.parts.appendValue(part)
        _moved(self.handle, latest + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._closed(key)

    def close(self) -> None:
        pass


def stream_units(packets: DataFrame, idle: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """media_id, pid, at, packets, payload: units as soon as the next one of their stream starts, or no packet has come for idle.

    packets is a stream of media_id, pid, at (long), starts, payload, ts; what comes before a stream's first start is left
    out. Packets of a stream have to come in the order of at from batch to batch; within a batch their order doesn't matter.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = T.StructType([packets.schema["media_id"], packets.schema["pid"], T.StructField("at", T.LongType()), T.StructField("packets", T.IntegerType()), T.StructField("payload", T.BinaryType())])
    return packets.withWatermark("ts", late).groupBy("media_id", "pid").transformWithState(_Units(_millis(idle)), out, "append", "EventTime")


_TAG = re.compile(r"#EXT(?:-X-)?(MEDIA-SEQUENCE|INF):([^,\r\n]*)")


def playlist_segments(text: str | None) -> list[tuple[int, str, float]]:
    """(sequence number, URI, seconds) of the segments of a media playlist."""
    first, seconds, out = 0, 0.0, []
    for line in (text or "").splitlines():
        line = line.strip()
        tag = _TAG.match(line)
        if tag:
            number = re.match(r"\d+(?:\.\d+)?", tag[2].strip())
            if tag[1] == "INF":
                seconds = float(number[0]) if number else 0.0
            else:
                first = int(float(number[0])) if number else 0
        elif line and not line.startswith("#"):
            out.append((first + len(out), line, seconds))
            seconds = 0.0
    return out


class _NewSegments(StatefulProcessor):
    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, latest = (self.last.get()[0] if self.last.exists() else -1), 0
        for r in sorted(rows, key=lambda r: (r["ts"], r["text"] or "")):
            latest = max(latest, int(r["ts"].timestamp() * 1000))
            for sequence, uri, seconds in playlist_segments(r["text"]):
                if sequence > last:
                    yield Row(media_id=key[0], sequence=sequence, uri=uri, seconds=seconds, polled_at=r["ts"])
                    last = sequence
        self.last.update((last,))
        _moved(self.handle, latest + self.forget)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def new_segments(polls: DataFrame, forget: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """media_id, sequence, uri, seconds, polled_at: each segment of a sliding playlist once, by its sequence number.

    polls is a stream of media_id, ts and text, the playlist as it was read then (of several at once, in the order of their
    texts); a playlist that hasn't been read for forget starts anew. Only the last sequence number of a playlist is held.
    """
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = T.StructType([polls.schema["media_id"], T.StructField("sequence", T.LongType()), T.StructField("uri", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("polled_at", T.TimestampType())])
    return polls.withWatermark("ts", late).groupBy("media_id").transformWithState(_NewSegments(_millis(forget)), out, "append", "EventTime")


def run_to_end(stream: DataFrame, label: str, checkpoint: str | None = None, folder: str | None = None) -> DataFrame:
    """Runs a stream over what there is now, into Parquet files that each batch commits once, and reads them.

    Files and checkpoint lie under spark.checkpoint.dir unless named; only in local mode does an unset folder fall back to a temporary one.
    """
    spark: SparkSession = stream.sparkSession
    if not (checkpoint and folder):
        own = shared_folder(spark, label)
        checkpoint, folder = checkpoint or f"{own}/checkpoint", folder or f"{own}/out"
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
