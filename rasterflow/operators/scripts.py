"""Playlists, cue sheets, subtitle headers and styled scripts read from text: each file is a media_id, each entry a row.

All are projections of the lines, and one window on media_id where a line's meaning depends on the ones before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc

# --- attribute lists: NAME=value,NAME="quoted, value" ---

_ATTRIBUTE = r'([A-Z0-9-]+)=(?:"([^"]*)"|([^,]*))'


def attribute(text: Column, name: str) -> Column:
    """The value of the last attribute of that name, without quotes; null without one."""
    part = lambda i: F.reverse(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(i)))
    at = F.array_position(part(1), name).cast("int")
    return F.when(at > 0, F.concat(F.element_at(part(2), at), F.element_at(part(3), at)))


def _number(text: Column, type_: str = "long") -> Column:
    return text.try_cast(type_)


def byte_range(text: Column) -> tuple[Column, Column]:
    """Length and offset of length[@offset]."""
    found = lambda i: F.regexp_extract(text, r"^(\d+)(?:@(\d+))?$", i).try_cast("long")
    return found(1), found(2)


def playlist_lines(files: DataFrame) -> DataFrame:
    """media_id, line_no, line, after: the trimmed lines with text, and the next one."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    each = files.select("media_id", lines.alias("lines")).select("media_id", "lines", F.posexplode("lines").alias("line_no", "line"))
    return each.select("media_id", "line_no", "line", F.try_element_at("lines", F.col("line_no") + 2).alias("after"))


def is_master(text: Column) -> Column:
    return text.contains("#EXT-X-STREAM-INF:") | text.contains("#EXT-X-MEDIA:")


def master_variants(files: DataFrame) -> DataFrame:
    """One row for each stream line that a URI follows: media_id, line_no, uri and the stream's attributes."""
    line = F.col("line")
    found = playlist_lines(files).where(line.startswith("#EXT-X-STREAM-INF:") & ~F.col("after").startswith("#"))
    size = attribute(line, "RESOLUTION")
    side = lambda i: F.regexp_extract(size, r"^(\d+)x(\d+)$", i).try_cast("int")
    return found.select(
        "media_id",
        "line_no",
        F.col("after").alias("uri"),
        F.coalesce(_number(attribute(line, "BANDWIDTH")), F.lit(0).cast("long")).alias("bandwidth"),
        _number(attribute(line, "AVERAGE-BANDWIDTH")).alias("average_bandwidth"),
        attribute(line, "CODECS").alias("codecs"),
        side(1).alias("width"),
        side(2).alias("height"),
        _number(attribute(line, "FRAME-RATE"), "double").alias("frame_rate"),
        *[attribute(line, n).alias(n.lower().replace("-", "_")) for n in ("HDCP-LEVEL", "AUDIO", "VIDEO", "SUBTITLES", "CLOSED-CAPTIONS")],
    )


def master_renditions(files: DataFrame) -> DataFrame:
    """One row for each media line of a master playlist; a missing group or name is empty, a missing flag false."""
    line = F.col("line")
    text = lambda n: attribute(line, n).alias(n.lower().replace("-", "_"))
    known = lambda n: F.coalesce(attribute(line, n), F.lit("")).alias(n.lower().replace("-", "_"))
    flag = lambda n: F.coalesce(attribute(line, n) == "YES", F.lit(False)).alias(n.lower())
    return playlist_lines(files).where(line.startswith("#EXT-X-MEDIA:")).select(
        "media_id", "line_no", text("TYPE"), text("URI"), known("GROUP-ID"), text("LANGUAGE"), text("ASSOC-LANGUAGE"), known("NAME"), flag("DEFAULT"), flag("AUTOSELECT"), flag("FORCED"), text("INSTREAM-ID"), text("CHARACTERISTICS"), text("CHANNELS")
    )


def media_segments(files: DataFrame) -> DataFrame:
    """media_id, seq, uri, duration, title, discontinuity, byte range, date, key and map of each URI of a media playlist.

    Tags before a URI belong to it; a key and a map hold for all URIs that follow, up to the next one.
    """
    line, order = F.col("line"), Window.partitionBy("media_id").orderBy("line_no")
    is_uri = ~line.startswith("#")
    lasting = lambda tag: F.last(F.when(line.startswith(tag), F.substr(line, F.lit(len(tag) + 1))), ignorenulls=True).over(order)
    rows = playlist_lines(files).withColumns({"seq": F.sum(is_uri.cast("int")).over(order) - is_uri.cast("int"), "key": lasting("#EXT-X-KEY:"), "map": lasting("#EXT-X-MAP:")})
    tagged = lambda tag: F.max_by(F.when(line.startswith(tag), F.substr(line, F.lit(len(tag) + 1))), F.when(line.startswith(tag), F.col("line_no")))
    units = rows.groupBy("media_id", "seq").agg(
        F.max_by("line", F.when(is_uri, F.col("line_no"))).alias("uri"),
        tagged("#EXTINF:").alias("inf"),
        F.max(line.startswith("#EXT-X-DISCONTINUITY") & ~line.startswith("#EXT-X-DISCONTINUITY-SEQUENCE:")).alias("discontinuity"),
        tagged("#EXT-X-BYTERANGE:").alias("range"),
        tagged("#EXT-X-PROGRAM-DATE-TIME:").alias("date"),
        F.max_by("key", "line_no").alias("key"),
        F.max_by("map", "line_no").alias("map"),
    ).where("uri IS NOT NULL")
    inf = lambda i: F.regexp_extract("inf", r"^([\d.]+)(?:,(.*))?$", i)
    length, offset = byte_range(F.col("range"))
    map_length, map_offset = byte_range(attribute(F.col("map"), "BYTERANGE"))
    method = F.when(F.col("key").isNotNull(), F.coalesce(attribute(F.col("key"), "METHOD"), F.lit("NONE")))
    return units.select(
        "media_id", F.col("seq").cast("int").alias("seq"), "uri", F.coalesce(inf(1).try_cast("double"), F.lit(0.0)).alias("duration"), F.trim(inf(2)).alias("title"), "discontinuity",
        length.alias("byte_length"), offset.alias("byte_offset"), F.col("date").try_cast("timestamp").alias("program_date_time"),
        method.alias("key_method"), attribute(F.col("key"), "URI").alias("key_uri"), attribute(F.col("key"), "IV").alias("key_iv"),
        attribute(F.col("map"), "URI").alias("map_uri"), map_length.alias("map_length"), map_offset.alias("map_offset"),
    )


def media_header(files: DataFrame) -> DataFrame:
    """media_id, version, target, media sequence, type and flags of a media playlist; the last line of a kind counts."""
    line = F.col("line")
    last = lambda tag: F.max_by(F.when(line.startswith(tag), F.substr(line, F.lit(len(tag) + 1))), F.when(line.startswith(tag), F.col("line_no")))
    any_of = lambda tag: F.max(line.startswith(tag))
    found = playlist_lines(files).groupBy("media_id").agg(last("#EXT-X-VERSION:").alias("version"), last("#EXT-X-TARGETDURATION:").alias("target"), last("#EXT-X-MEDIA-SEQUENCE:").alias("sequence"), last("#EXT-X-PLAYLIST-TYPE:").alias("playlist_type"), any_of("#EXT-X-I-FRAMES-ONLY").alias("i_frames_only"), any_of("#EXT-X-ENDLIST").alias("end_list"))
    whole = lambda c, default: F.coalesce(F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int"), F.lit(default))
    return found.select("media_id", whole("version", 1).alias("version"), whole("target", 0).alias("target_duration"), whole("sequence", 0).alias("media_sequence"), "playlist_type", "i_frames_only", "end_list")


# --- cue sheets ---


def _unquoted(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike('^".*"$') & (F.length(t) > 1), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def sheet_lines(files: DataFrame) -> DataFrame:
    """media_id, line_no, command, rest, line, file_no, track_no: commands in upper case; file and track count from 1, track 0 is the sheet's head."""
    each = files.select("media_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("line <> ''")
    command = F.upper(F.regexp_extract("line", r"^(\S+)", 1))
    order = Window.partitionBy("media_id").orderBy("line_no")
    rows = each.select("media_id", "line_no", "line", command.alias("command"), F.regexp_replace("line", r"^\S+\s*", "").alias("rest"))
    count = lambda c: F.sum((F.col("command") == c).cast("int")).over(order).cast("int")
    return rows.withColumns({"file_no": count("FILE"), "track_no": count("TRACK")})


def _last(command: str, value: Column) -> Column:
    mine = F.col("command") == command
    return F.max_by(F.when(mine, value), F.when(mine, F.col("line_no")))


def read_cue(files: DataFrame) -> DataFrame:
    """One row for each track: media_id, file_no, filename, file_type, number, type, title, performer, isrc, flags, pregap, postgap and start_frames.

    A track starts at index 1, or else at its first index, or at 0. Tracks before the first file are left out.
    """
    rows = sheet_lines(files)
    rest = F.col("rest")
    name = F.coalesce(F.nullif(F.regexp_extract("rest", r'^"([^"]+)"', 1), F.lit("")), F.regexp_extract("rest", r"^(\S+)", 1))
    kind = F.upper(F.regexp_extract("rest", r'^(?:"[^"]+"|\S+)\s+(\S+)', 1))
    sources = rows.where("command = 'FILE'").groupBy("media_id", "file_no").agg(F.max(F.struct(name.alias("filename"), kind.alias("file_type"))).alias("f")).select("media_id", "file_no", "f.*")
    frames = lambda c: tc.parse_cue(F.regexp_extract(c, r"(\d+:\d{2}:\d{2})", 1))
    index = F.regexp_extract("rest", r"^(\d+)\s+\d+:\d{2}:\d{2}", 1).try_cast("int")
    at = F.when((F.col("command") == "INDEX") & index.isNotNull(), frames("rest"))
    tracks = rows.where("track_no > 0 AND file_no > 0").groupBy("media_id", "track_no").agg(
        F.min("file_no").alias("file_no"),
        _last("TRACK", F.regexp_extract("rest", r"^(\d+)", 1).try_cast("int")).alias("number"),
        _last("TRACK", F.upper(F.regexp_extract("rest", r"^\d+\s+(\S+)", 1))).alias("type"),
        *[_last(c.upper(), _unquoted(rest)).alias(c) for c in ("title", "performer", "songwriter")],
        _last("ISRC", rest).alias("isrc"),
        _last("FLAGS", F.upper(F.regexp_replace("rest", r"\s+", " "))).alias("flags"),
        _last("PREGAP", frames("rest")).alias("pregap_frames"),
        _last("POSTGAP", frames("rest")).alias("postgap_frames"),
        F.min_by(F.when(index == 1, at), F.when((index == 1) & at.isNotNull(), F.col("line_no"))).alias("first"),
        F.min_by(at, F.when(at.isNotNull(), F.col("line_no"))).alias("any"),
    )
    out = tracks.withColumn("start_frames", F.coalesce("first", "any", F.lit(0)).cast("long")).drop("first", "any", "track_no")
    return out.join(sources, ["media_id", "file_no"], "left")


def cue_info(files: DataFrame) -> DataFrame:
    """media_id, title and performer (the first ones of the file), tracks, files, and the latest index in seconds."""
    rows = sheet_lines(files)
    first = lambda c: F.min_by(F.when(F.col("command") == c, _unquoted(F.col("rest"))), F.when((F.col("command") == c) & (F.col("rest") != ""), F.col("line_no")))
    count = lambda c: F.sum((F.col("command") == c).cast("long"))
    time = F.when(F.col("command") == "INDEX", tc.parse_cue(F.regexp_extract("rest", r"^\d+\s+(\d+:\d{2}:\d{2})", 1)))
    return rows.groupBy("media_id").agg(first("TITLE").alias("title"), first("PERFORMER").alias("performer"), count("TRACK").alias("tracks"), count("FILE").alias("files"), (F.coalesce(F.max(time), F.lit(0)) / 75).alias("duration_s"))


def write_cue(tracks: DataFrame, file_type: str = "WAVE") -> DataFrame:
    """media_id, text: sheets of one file each from tracks (media_id, filename, album, artist, number, title, performer, start_frames); nulls leave their line out."""
    line = lambda form, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.format_string(form, F.col(c)))
    block = F.concat_ws("\n", F.format_string("  TRACK %02d AUDIO", F.col("number").cast("int")), line('    TITLE "%s"', "title"), line('    PERFORMER "%s"', "performer"), F.concat(F.lit("    INDEX 01 "), tc.format_cue(F.col("start_frames"))))
    sheets = tracks.withColumn("block", block).groupBy("media_id").agg(*[F.max(c).alias(c) for c in ("filename", "album", "artist")], F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda b: b["block"]).alias("blocks"))
    head = F.concat_ws("\n", line('PERFORMER "%s"', "artist"), line('TITLE "%s"', "album"), F.format_string(f'FILE "%s" {file_type}', F.col("filename")))
    return sheets.select("media_id", F.concat(F.concat_ws("\n", head, F.array_join("blocks", "\n")), F.lit("\n")).alias("text"))


# --- subtitle files ---

_SRT_LINE = r"\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}"
_VTT_LINE = r"(?:\d{2}:)?\d{2}:\d{2}\.\d{3}\s*-->\s*(?:\d{2}:)?\d{2}:\d{2}\.\d{3}"


def subtitle_format(text: Column) -> Column:
    """vtt, srt or null."""
    bare = F.regexp_replace(text, r"^[\s﻿]+", "")
    return F.when(bare.startswith("WEBVTT"), F.lit("vtt")).when(bare.rlike(r"^\d+[ \t]*[\r\n]") & bare.rlike(_SRT_LINE), F.lit("srt"))


def subtitle_info(files: DataFrame) -> DataFrame:
    """media_id, format, cues, duration (the latest end), has_styles, has_regions; files of neither format are left out."""
    rows = files.withColumn("format", subtitle_format(F.col("text"))).where("format IS NOT NULL")
    vtt = F.col("format") == "vtt"
    ends = lambda p, parse: F.transform(F.regexp_extract_all("text", F.lit(rf"-->\s*({p})"), F.lit(1)), parse)
    clock = lambda pattern: lambda x: tc.parse_clock(x, pattern)
    srt_ends, vtt_ends = ends(r"\d{2}:\d{2}:\d{2}[,.]\d{3}", clock(tc.SRT_TIME)), ends(r"(?:\d{2}:)?\d{2}:\d{2}\.\d{3}", clock(tc.VTT_TIME))
    return rows.select(
        "media_id", "format", F.when(vtt, F.regexp_count("text", F.lit(_VTT_LINE))).otherwise(F.regexp_count("text", F.lit(_SRT_LINE))).cast("long").alias("cues"),
        F.coalesce(F.array_max(F.when(vtt, vtt_ends).otherwise(srt_ends)), F.lit(0.0)).alias("duration"),
        (vtt & F.col("text").contains("STYLE")).alias("has_styles"), (vtt & F.col("text").contains("REGION")).alias("has_regions"),
    )


def setting(text: Column, key: str) -> Column:
    """The value of the last key:value pair of that key."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<!\S){key}:([^\s:]+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def vtt_blocks(files: DataFrame) -> DataFrame:
    """media_id, block_no, block: the trimmed blocks after the header's."""
    each = files.select("media_id", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), r"\r?\n\r?\n")).alias("block_no", "raw"))
    return each.where("block_no > 0").select("media_id", "block_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("block")).where("block <> ''")


def vtt_settings(files: DataFrame) -> DataFrame:
    """media_id, block_no, id, vertical, line, position, size, align, region, text of each cue."""
    rows = vtt_blocks(files).where(~F.col("block").rlike("^(REGION|STYLE|NOTE)")).withColumn("lines", F.split("block", r"\r?\n"))
    own = F.when(~F.col("lines")[0].contains("-->"), F.trim(F.col("lines")[0]))
    line = F.when(F.col("lines")[0].contains("-->"), F.col("lines")[0]).otherwise(F.try_element_at("lines", F.lit(2)))
    after = F.regexp_extract(line, rf"{_VTT_LINE}\s+(.*)", 1)
    said = F.array_join(F.slice("lines", F.when(F.col("lines")[0].contains("-->"), 2).otherwise(3), F.greatest(F.size("lines"), F.lit(1))), "\n")
    found = rows.withColumns({"id": own, "settings": after, "text": said}).where(line.rlike(_VTT_LINE))
    return found.select("media_id", "block_no", "id", *[setting(F.col("settings"), k).alias(k) for k in ("vertical", "line", "position", "size", "align", "region")], "text")


def vtt_regions(files: DataFrame) -> DataFrame:
    """media_id, block_no, id, width, lines, regionanchor, viewportanchor, scroll; regions without an id are left out."""
    text = F.regexp_replace(F.regexp_replace("block", r"^[^\n]*\n?", ""), r"\s+", " ")
    rows = vtt_blocks(files).where(F.col("block").startswith("REGION")).withColumn("pairs", text)
    value = lambda k: setting(F.col("pairs"), k)
    return rows.select("media_id", "block_no", value("id").alias("id"), value("width").alias("width"), value("lines").try_cast("int").alias("lines"), *[value(k).alias(k) for k in ("regionanchor", "viewportanchor", "scroll")]).where("id IS NOT NULL")


def vtt_styles(files: DataFrame) -> DataFrame:
    """media_id, block_no, css of each style block with content."""
    css = F.regexp_replace(F.regexp_replace(F.regexp_replace("block", r"^[^\n]*\n?", ""), r"\r\n", "\n"), r"^\s+|\s+$", "")
    return vtt_blocks(files).where(F.col("block").startswith("STYLE")).select("media_id", "block_no", css.alias("css")).where("css <> ''")


# --- styled scripts (ASS and SSA) ---


def ass_lines(files: DataFrame) -> DataFrame:
    """media_id, line_no, line, section (lower case), fields (names of the section's last format line so far)."""
    each = files.where(F.col("text").contains("[Script Info]")).select("media_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    order = Window.partitionBy("media_id").orderBy("line_no")
    header = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    rows = each.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower(header)), ignorenulls=True).over(order))
    form = F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.substr(F.col("line"), F.lit(8)), ","), lambda x: F.lower(F.trim(x))))
    fields = F.last(form, ignorenulls=True).over(Window.partitionBy("media_id", "section").orderBy("line_no"))
    return rows.withColumn("fields", fields).where((F.col("line") != "") & ~F.col("line").startswith(";") & ~F.col("line").rlike(r"^\[.*\]$")).drop("raw")


def _entries(lines: DataFrame, tag: str) -> DataFrame:
    """The lines of that tag with parts: as many as the format has fields, the last one with all further commas."""
    body = F.substr(F.col("line"), F.lit(len(tag) + 2))
    parts = F.split(body, ",", -1)
    n = F.size("fields")
    kept = F.concat(F.slice(parts, F.lit(1), n - 1), F.array(F.array_join(F.slice(parts, n, F.greatest(F.size(parts) - n + 1, F.lit(0))), ",")))
    return lines.where(F.col("line").startswith(f"{tag}:") & (F.size("fields") > 0)).where(F.size(parts) >= n).withColumn("parts", kept)


def _field(*names: str) -> Column:
    """The part of the first of the named fields that the format has."""
    at = lambda n: F.array_position("fields", n).cast("int")
    return F.coalesce(*[F.when(at(n) > 0, F.try_element_at("parts", at(n))) for n in names])


def ass_events(files: DataFrame, tag: str = "Dialogue") -> DataFrame:
    """media_id, line_no, layer, start_s, end_s, style, name, effect, margins and text of each Dialogue (or Comment) line."""
    rows = _entries(ass_lines(files).where("section = 'events'"), tag)
    whole = lambda *n: F.coalesce(F.trim(_field(*n)).try_cast("int"), F.lit(0))
    seconds = lambda n: F.coalesce(tc.parse_ass_time(F.trim(_field(n))), F.lit(0.0))
    return rows.select("media_id", "line_no", whole("layer", "marked").alias("layer"), seconds("start").alias("start_s"), seconds("end").alias("end_s"), F.coalesce(_field("style"), F.lit("Default")).alias("style"), F.coalesce(_field("name", "actor"), F.lit("")).alias("name"), *[whole(m).alias(m) for m in ("marginl", "marginr", "marginv")], F.coalesce(_field("effect"), F.lit("")).alias("effect"), F.coalesce(_field("text"), F.lit("")).alias("text"))


def ass_styles(files: DataFrame) -> DataFrame:
    """media_id, line_no, name, font, size, colours and flags of each style line."""
    rows = _entries(ass_lines(files).where("section IN ('v4 styles', 'v4+ styles')"), "Style")
    flag = lambda n: F.coalesce(F.trim(_field(n)).isin("-1", "1"), F.lit(False))
    text = lambda *n: F.trim(_field(*n))
    return rows.select("media_id", "line_no", text("name").alias("name"), text("fontname").alias("font"), text("fontsize").try_cast("double").alias("size"), text("primarycolour").alias("primary_color"), text("outlinecolour", "tertiarycolour").alias("outline_color"), *[flag(n).alias(n) for n in ("bold", "italic", "underline", "strikeout")], text("alignment").try_cast("int").alias("alignment"))


def ass_info(files: DataFrame) -> DataFrame:
    """media_id, format (ass or ssa), title, resolution, styles, dialogues, duration (the latest end)."""
    form = F.when(F.col("text").contains("ScriptType: v4.00+") | F.col("text").contains("v4+ Styles"), F.lit("ass")).when(F.col("text").contains("ScriptType: v4.00") | F.col("text").contains("V4 Styles"), F.lit("ssa")).otherwise(F.lit("ass"))
    each = files.select("media_id", form.alias("format"), F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    line = F.col("line")
    last = lambda tag: F.max_by(F.when(line.startswith(tag), F.trim(F.substr(line, F.lit(len(tag) + 1)))), F.when(line.startswith(tag), F.col("line_no")))
    end = F.when(line.startswith("Dialogue:"), tc.parse_ass_time(F.trim(F.try_element_at(F.split(F.substr(line, F.lit(10)), ","), F.lit(3)))))
    found = each.groupBy("media_id").agg(F.max("format").alias("format"), last("Title:").alias("title"), last("PlayResX:").try_cast("int").alias("width"), last("PlayResY:").try_cast("int").alias("height"), F.sum(line.startswith("Style:").cast("long")).alias("styles"), F.sum(line.startswith("Dialogue:").cast("long")).alias("dialogues"), F.coalesce(F.max(end), F.lit(0.0)).alias("duration"))
    return found


def ass_color(text: Column) -> Column:
    """alpha, blue, green, red of &HAABBGGRR or &HBBGGRR."""
    digits = F.regexp_replace(F.regexp_replace(text, "(?i)^&H", ""), "(?i)^H", "")
    value = F.conv(digits, 16, 10).cast("long")
    byte = lambda shift: F.shiftright(value, shift).bitwiseAND(255).cast("int")
    return F.struct(F.when(F.length(digits) <= 6, 0).otherwise(byte(24)).alias("alpha"), byte(16).alias("blue"), byte(8).alias("green"), byte(0).alias("red"))


def format_ass_color(alpha: Column, blue: Column, green: Column, red: Column) -> Column:
    two = lambda c: F.lpad(F.hex(c.bitwiseAND(255).cast("long")), 2, "0")
    return F.concat(F.lit("&H"), two(alpha), two(blue), two(green), two(red))


def write_ass(cues: DataFrame, title: str = "Subtitles", style: str = "Default") -> DataFrame:
    """media_id, text: cues (media_id, cue_no, start_s, end_s, text) as one script each, breaks as \\N."""
    body = F.regexp_replace("text", r"\r?\n", r"\\N")
    line = F.concat(F.lit("Dialogue: 0,"), tc.format_ass_time(F.col("start_s")), F.lit(","), tc.format_ass_time(F.col("end_s")), F.lit(f",{style},,0,0,0,,"), body)
    scripts = cues.withColumn("line", line).groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "line"))), lambda b: b["line"]).alias("lines"))
    head = f"[Script Info]\nTitle: {title}\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, Bold, Italic, Alignment\nStyle: {style},Arial,20,&H00FFFFFF,0,0,2\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    return scripts.select("media_id", F.concat(F.lit(head), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
