"""Timed text, playlists, cue sheets and notes as DataFrames: each file is a media_id, each line or cue a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc

# --- subtitles ---


def write_srt(cues: DataFrame) -> DataFrame:
    """media_id, text: cues (media_id, cue_no, start_s, end_s, text) as one SRT file each."""
    block = F.concat_ws("\n", F.col("cue_no").cast("string"), F.concat(tc.format_clock(F.col("start_s")), F.lit(" --> "), tc.format_clock(F.col("end_s"))), F.col("text"))
    return _joined(cues.withColumn("block", block), "\n\n", "", "\n")


def write_vtt(cues: DataFrame, header: str = "") -> DataFrame:
    block = F.concat_ws("\n", F.concat(tc.format_clock(F.col("start_s"), "."), F.lit(" --> "), tc.format_clock(F.col("end_s"), ".")), F.col("text"))
    return _joined(cues.withColumn("block", block), "\n\n", f"WEBVTT{' ' + header if header else ''}\n\n", "\n")


def _joined(blocks: DataFrame, between: str, before: str, after: str, order: str = "cue_no") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda b: b["block"])
    return blocks.groupBy("media_id").agg(ordered.alias("b")).select("media_id", F.concat(F.lit(before), F.array_join("b", between), F.lit(after)).alias("text"))


def _cues(files: DataFrame, block: Column, time: str, pattern: str) -> DataFrame:
    """Blocks with a time line; the lines after it are the text. Blocks without one or without text are left out."""
    split = files.select("media_id", F.posexplode(F.split(block, r"\r?\n\r?\n+")).alias("block_no", "block"))
    lines = split.withColumn("lines", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), r"\r?\n"))
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->").cast("int")), 1)
    timed = lines.withColumn("at", at).where(F.col("at").between(1, 2))
    line = F.element_at("lines", F.col("at").cast("int"))
    fields = timed.withColumns({"from": F.regexp_extract(line, time, 1), "to": F.regexp_extract(line, time, 2), "id": F.when(F.col("at") == 2, F.element_at("lines", 1)), "text": F.array_join(F.slice("lines", (F.col("at") + 1).cast("int"), F.size("lines")), "\n")})
    return fields.where((F.col("from") != "") & (F.trim("text") != "")).select("media_id", "block_no", "id", tc.parse_clock(F.col("from"), pattern).alias("start_s"), tc.parse_clock(F.col("to"), pattern).alias("end_s"), "text")


def read_srt(files: DataFrame) -> DataFrame:
    """media_id, block_no, idx, start_s, end_s, text from files (media_id, text); blocks without a number are left out."""
    found = _cues(files, F.regexp_replace("text", "^﻿", ""), r"^\s*(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)", tc.SRT_TIME)
    return found.withColumn("idx", F.regexp_extract("id", r"^\s*(\d+)\s*$", 1).try_cast("int")).where("idx IS NOT NULL").select("media_id", "block_no", "idx", "start_s", "end_s", "text")


def read_vtt(files: DataFrame) -> DataFrame:
    """As read_srt(), with an id in place of the number; note, style and region blocks have no times and fall out."""
    return _cues(files, F.regexp_replace("text", "^﻿", ""), r"^\s*((?:\d+:)?\d+:\d+\.\d+)\s*-->\s*((?:\d+:)?\d+:\d+\.\d+)", tc.VTT_TIME)


def strip_ass_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"\{[^}]*\}", "")


def ass_plain(text: Column) -> Column:
    """Dialogue text without tags, with its breaks as new lines."""
    return F.regexp_replace(strip_ass_tags(text), r"(?i)\\n", "\n")


# --- playlists: lines (media_id, line_no, line) ---


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("media_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")


def playlist_segments(files: DataFrame) -> DataFrame:
    """media_id, seq, uri, duration, title, discontinuity, key: tags apply to the next URI, a key to all that follow."""
    lines = lines_of(files)
    order = Window.partitionBy("media_id").orderBy("line_no")
    is_uri = ~F.col("line").startswith("#")
    numbered = lines.withColumn("seq", (F.coalesce(F.sum(is_uri.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
    keyed = numbered.withColumn("key", F.last(F.when(F.col("line").startswith("#EXT-X-KEY:"), F.regexp_extract("line", "METHOD=([^,]+)", 1)), ignorenulls=True).over(order))
    inf = F.col("line").startswith("#EXTINF:")
    grouped = keyed.groupBy("media_id", "seq").agg(
        F.max(F.when(is_uri, F.col("line"))).alias("uri"),
        F.max(F.when(inf, F.regexp_extract("line", r"#EXTINF:([0-9.]+)", 1).try_cast("double"))).alias("duration"),
        F.max(F.when(inf, F.regexp_extract("line", r"#EXTINF:[^,]*,(.*)", 1))).alias("title"),
        F.max(F.col("line").startswith("#EXT-X-DISCONTINUITY")).alias("discontinuity"),
        F.max_by("key", "line_no").alias("key"),
    )
    return grouped.where("uri IS NOT NULL")


def playlist_info(files: DataFrame) -> DataFrame:
    """media_id, segments, total duration, whether live (without an end) and whether encrypted."""
    line = F.col("line")
    return lines_of(files).groupBy("media_id").agg(
        F.sum(line.startswith("#EXTINF:").cast("long")).alias("segments"),
        F.round(F.coalesce(F.sum(F.regexp_extract("line", r"#EXTINF:([0-9.]+)", 1).try_cast("double")), F.lit(0.0)), 6).alias("duration"),
        (~F.max(line.startswith("#EXT-X-ENDLIST"))).alias("live"),
        F.max(line.startswith("#EXT-X-KEY:") & ~line.contains("METHOD=NONE")).alias("encrypted"),
    )


def write_playlist(segments: DataFrame) -> DataFrame:
    """media_id, text from segments (media_id, seq, uri, duration, discontinuity, key): a key line only where it changes."""
    order = Window.partitionBy("media_id").orderBy("seq")
    changed = F.coalesce(F.col("key") != F.lag("key").over(order), F.col("key").isNotNull() & (F.row_number().over(order) == 1) & (F.col("key") != "NONE"))
    block = F.concat_ws("\n", F.when(F.col("discontinuity"), F.lit("#EXT-X-DISCONTINUITY")), F.when(F.col("changed"), F.concat(F.lit("#EXT-X-KEY:METHOD="), F.col("key"))), F.format_string("#EXTINF:%.6f,", "duration"), F.col("uri"))
    top = Window.partitionBy("media_id")
    rows = segments.withColumn("changed", changed).withColumn("target", F.ceil(F.greatest(F.max("duration").over(top), F.lit(1.0)))).withColumn("block", block)
    out = rows.groupBy("media_id").agg(F.max("target").alias("target"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda b: b["block"]).alias("b"))
    return out.select("media_id", F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:"), F.col("target").cast("string"), F.lit("\n"), F.array_join("b", "\n"), F.lit("\n#EXT-X-ENDLIST\n")).alias("text"))


# --- cue sheets: tracks (media_id, number, start_frames) ---


def track_durations(tracks: DataFrame, total_frames: Column | None = None) -> DataFrame:
    """Seconds to the next track's start, of the last one to total_frames."""
    after = F.lead("start_frames").over(Window.partitionBy("media_id").orderBy("number"))
    return tracks.withColumn("duration_s", (F.coalesce(after, total_frames if total_frames is not None else F.lit(None).cast("long")) - F.col("start_frames")) / 75)


def merge_sheets(tracks: DataFrame) -> DataFrame:
    """Numbers anew from 1 in the order of media_id and number, within each group (media_id is a long).

    Tracks are numbered within their sheet, and sheets are offset by two levels of prefix sums over counts, of ranges of
    4,096 ids and of the sheets within a range, so that no window holds a whole group.
    """
    sheets = tracks.groupBy("group", "media_id").agg(F.count(F.lit(1)).alias("__n")).withColumn("__range", F.shiftright("media_id", 12))
    ranges = sheets.groupBy("group", "__range").agg(F.sum("__n").alias("__m"))
    ranges = ranges.select("group", "__range", (F.sum("__m").over(Window.partitionBy("group").orderBy("__range")) - F.col("__m")).alias("__before"))
    within = Window.partitionBy("group", "__range").orderBy("media_id")
    offsets = sheets.withColumn("__in", F.sum("__n").over(within) - F.col("__n")).join(ranges, ["group", "__range"]).select("group", "media_id", (F.col("__before") + F.col("__in")).alias("__offset"))
    own = F.row_number().over(Window.partitionBy("group", "media_id").orderBy("number"))
    return tracks.withColumn("number", own).join(offsets, ["group", "media_id"]).withColumn("number", (F.col("number") + F.col("__offset")).cast("int")).select(*tracks.columns)


def offset_tracks(tracks: DataFrame, seconds: float) -> DataFrame:
    return tracks.withColumn("start_frames", F.greatest(F.lit(0).cast("long"), F.col("start_frames") + tc.cue_frames(F.lit(float(seconds)))))


# --- notes: events (media_id, tick, ...) ---


def note_events(notes: DataFrame) -> DataFrame:
    """media_id, seq, tick, delta, on, note, velocity from notes (media_id, note, velocity, start, length): ends before starts on one tick."""
    edges = F.array(F.struct(F.col("start").alias("tick"), F.lit(True).alias("on"), "note", "velocity"), F.struct((F.col("start") + F.col("length")).alias("tick"), F.lit(False).alias("on"), "note", F.lit(0).alias("velocity")))
    order = Window.partitionBy("media_id").orderBy("tick", "on", "note", "velocity")
    events = notes.select("media_id", F.explode(edges).alias("e")).select("media_id", "e.*")
    return events.withColumns({"seq": F.row_number().over(order), "delta": F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0).cast("long"))})


def tempo_seconds(tempos: DataFrame, last: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """media_id, seconds up to last (media_id, last_tick) with tempos (media_id, tick, micros a beat); 500000 before the first."""
    order = Window.partitionBy("media_id").orderBy("tick", "micros")
    spans = tempos.withColumns({"before": F.coalesce(F.lag("micros").over(order), F.lit(500000).cast("long")), "since": F.coalesce(F.lag("tick").over(order), F.lit(0).cast("long"))})
    summed = spans.groupBy("media_id").agg(F.sum((F.col("tick") - F.col("since")) * F.col("before")).alias("done"), F.max(F.struct("tick", "micros")).alias("end"))
    joined = last.join(summed, "media_id", "left")
    rest = F.greatest(F.lit(0).cast("long"), F.col("last_tick") - F.coalesce(F.col("end.tick"), F.lit(0).cast("long"))) * F.coalesce(F.col("end.micros"), F.lit(500000).cast("long"))
    return joined.select("media_id", ((F.coalesce("done", F.lit(0).cast("long")) + rest) / F.lit(ticks_per_beat * 1e6)).alias("seconds"))


# --- ordered folds ---


def reassemble(packets: DataFrame) -> DataFrame:
    """media_id, unit, packets, bytes from packets (media_id, seq, start, size): a unit lasts from one start flag to the next."""
    order = Window.partitionBy("media_id").orderBy("seq")
    units = packets.withColumn("unit", F.sum(F.col("start").cast("int")).over(order)).where("unit > 0")
    return units.groupBy("media_id", "unit").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


def laced_packets(segments: DataFrame) -> DataFrame:
    """media_id, packet, bytes, pages, complete from segments (media_id, page, i, size): a segment under 255 bytes ends its packet, on whatever page."""
    order = Window.partitionBy("media_id").orderBy("page", "i")
    ended = (F.col("size") < 255).cast("int")
    numbered = segments.withColumn("packet", F.sum(ended).over(order) - ended)
    return numbered.groupBy("media_id", "packet").agg(F.sum("size").alias("bytes"), (F.max("page") - F.min("page") + 1).alias("pages"), (F.min("size") < 255).alias("complete"))


def cluster_times(blocks: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """blocks (media_id, seq, cluster, relative) with seconds: a block's time is that of the last cluster before it and its own.

    cluster is the time of a cluster head and null for blocks; times are in units of scale nanoseconds. Heads go.
    """
    base = F.last("cluster", ignorenulls=True).over(Window.partitionBy("media_id").orderBy("seq"))
    timed = blocks.withColumn("base", F.coalesce(base, F.lit(0)))
    return timed.where("cluster IS NULL").select("media_id", "seq", ((F.col("base") + F.col("relative")) * F.lit(float(scale)) / 1e9).alias("seconds"))


def fixed_prediction(samples: DataFrame, order: int) -> DataFrame:
    """The residual of the fixed polynomial predictor of that order, null for the first samples."""
    w = Window.partitionBy("media_id").orderBy("i")
    residual = F.col("sample")
    signs = {1: (1, -1), 2: (1, -2, 1), 3: (1, -3, 3, -1), 4: (1, -4, 6, -4, 1)}[order]
    residual = sum(F.lag("sample", k).over(w) * s for k, s in enumerate(signs) if k) + F.col("sample")
    return samples.withColumn("residual", residual)


def moving_average(samples: DataFrame, reach: int = 8) -> DataFrame:
    return samples.withColumn("mean", F.avg("sample").over(Window.partitionBy("media_id").orderBy("i").rowsBetween(-reach, reach)))
