"""Queries that read playlists, cue sheets, subtitle files and scripts, and their SQL.

The files are spelt out here from the driver's tables, in ways that the library's own writers don't use: both line ends,
attributes in changing order, blank lines, comments, quotes. The SQL takes the expected rows from the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import playlists
from ..operators import scripts as sc
from .views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def _files(rows: DataFrame, media_id: str, order: list[str], block: Column, head: str = "", end: Column | None = None) -> DataFrame:
    """media_id, text: the blocks of each file in order; files with an odd id have CRLF as line ends."""
    own = rows.select(F.col(media_id).cast("long").alias("media_id"), F.struct(*order, block.alias("block")).alias("b"))
    text = own.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "").alias("text"))
    whole = F.concat(F.lit(head), F.col("text"))
    return text.select("media_id", F.when(F.col("media_id") % 2 == 1, F.replace(whole, F.lit("\n"), F.lit("\r\n"))).otherwise(whole).alias("text"))


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- playlists ---


def masters(spark: SparkSession, sf: str) -> DataFrame:
    """A master playlist for each customer: a stream for each order; every fifth has a comment in place of its URI."""
    k = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("long")
    size = F.concat(F.lit("RESOLUTION="), _s(k % 1920 + 1), F.lit("x"), _s(k % 1080 + 1))
    rate = F.concat(F.lit("BANDWIDTH="), _s(price))
    rest = F.concat(F.lit('CODECS="avc1.'), _s(k), F.lit(',mp4a.40.2",AVERAGE-BANDWIDTH='), _s(k), F.lit(',FRAME-RATE=29.97,AUDIO="a b"'))
    tag = F.concat(F.lit("#EXT-X-STREAM-INF:"), F.when(k % 2 == 0, F.concat_ws(",", rate, size, rest)).otherwise(F.concat_ws(",", rest, size, rate)))
    uri = F.when(k % 5 == 0, F.lit("# none")).otherwise(F.concat(F.lit("  v/"), _s(k), F.lit(".m3u8 ")))
    return _files(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], F.concat(tag, F.lit("\n\n"), uri, F.lit("\n")), "#EXTM3U\n#EXT-X-VERSION:6\n")


@_query("SELECT o_custkey AS media_id, 'v/' || o_orderkey || '.m3u8' AS uri, CAST(floor(o_totalprice) AS BIGINT) AS bandwidth, o_orderkey AS average_bandwidth, 'avc1.' || o_orderkey || ',mp4a.40.2' AS codecs, CAST(o_orderkey % 1920 + 1 AS INTEGER) AS width, CAST(o_orderkey % 1080 + 1 AS INTEGER) AS height, CAST(29.97 AS DOUBLE) AS frame_rate, 'a b' AS audio FROM orders WHERE o_orderkey % 5 <> 0")
def m3u8_master(spark, sf):
    return sc.master_variants(masters(spark, sf)).select("media_id", "uri", "bandwidth", "average_bandwidth", "codecs", "width", "height", "frame_rate", "audio")


@_query("SELECT s_nationkey AS media_id, 'AUDIO' AS type, 'a/' || s_suppkey || ',x.m3u8' AS uri, 'g=' || s_nationkey AS group_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'l' || s_suppkey % 7 END AS language, s_name AS name, s_suppkey % 2 = 0 AS \"default\", true AS autoselect, false AS forced FROM (SELECT *, CAST(s_nationkey AS BIGINT) AS n FROM supplier)")
def m3u8_renditions(spark, sf):
    k = F.col("s_suppkey")
    line = F.concat(F.lit('#EXT-X-MEDIA:TYPE=AUDIO,URI="a/'), _s(k), F.lit(',x.m3u8",GROUP-ID="g='), _s("s_nationkey"), F.lit('"'), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(",LANGUAGE=l"), _s(k % 7))), F.lit(',NAME="'), F.col("s_name"), F.lit('",AUTOSELECT=YES,DEFAULT='), F.when(k % 2 == 0, F.lit("YES")).otherwise(F.lit("NO")), F.lit("\n"))
    found = sc.master_renditions(_files(table(spark, sf, "supplier"), "s_nationkey", ["s_suppkey"], line, "#EXTM3U\n"))
    return found.select(F.col("media_id").cast("int").alias("media_id"), "type", "uri", "group_id", "language", "name", "default", "autoselect", "forced")


def medias(spark: SparkSession, sf: str) -> DataFrame:
    """A media playlist for each order: a segment for each line item, keys and maps where a line's flags say so."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    key = F.when(F.col("l_returnflag") == "A", F.lit("#EXT-X-KEY:METHOD=NONE\n")).when(F.col("l_returnflag") == "R", F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="k/'), _s(p), F.lit('",IV=0x'), _s(n), F.lit("\n"))).otherwise(F.lit(""))
    init = F.when(F.col("l_linestatus") == "F", F.concat(F.lit('#EXT-X-MAP:BYTERANGE="'), _s(n), F.lit("@"), _s(p), F.lit('",URI="init,'), _s(p), F.lit('.mp4"\n'))).otherwise(F.lit(""))
    gap = F.when(n % 3 == 0, F.lit("#EXT-X-DISCONTINUITY\n")).otherwise(F.lit(""))
    cut = F.when(p % 2 == 0, F.concat(F.lit("#EXT-X-BYTERANGE:"), _s(p), F.when(p % 4 == 0, F.concat(F.lit("@"), _s(n))).otherwise(F.lit("")), F.lit("\n"))).otherwise(F.lit(""))
    inf = F.concat(F.lit("#EXTINF:"), F.format_string("%.3f", F.col("l_quantity")), F.when(p % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(", part, "), _s(p))), F.lit("\n# a remark\n"))
    block = F.concat(key, init, gap, cut, inf, F.lit("s"), _s(n), F.lit("-"), _s(p), F.lit(".ts\n"))
    return _files(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], block, "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n\n")


@_query("""WITH s AS (SELECT *, row_number() OVER w - 1 AS seq, last_value(CASE l_returnflag WHEN 'A' THEN 'NONE' WHEN 'R' THEN 'AES-128' END IGNORE NULLS) OVER w AS key_method, last_value(CASE l_returnflag WHEN 'A' THEN '' WHEN 'R' THEN 'k/' || l_partkey END IGNORE NULLS) OVER w AS key_uri, last_value(CASE l_returnflag WHEN 'A' THEN '' WHEN 'R' THEN '0x' || l_linenumber END IGNORE NULLS) OVER w AS key_iv,
last_value(CASE WHEN l_linestatus = 'F' THEN 'init,' || l_partkey || '.mp4' END IGNORE NULLS) OVER w AS map_uri, last_value(CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS BIGINT) END IGNORE NULLS) OVER w AS map_length, last_value(CASE WHEN l_linestatus = 'F' THEN l_partkey END IGNORE NULLS) OVER w AS map_offset
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey AS media_id, CAST(seq AS INTEGER) AS seq, 's' || l_linenumber || '-' || l_partkey || '.ts' AS uri, l_quantity AS duration, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'part, ' || l_partkey END AS title, l_linenumber % 3 = 0 AS discontinuity, CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS byte_length, CASE WHEN l_partkey % 4 = 0 THEN CAST(l_linenumber AS BIGINT) END AS byte_offset, key_method, nullif(key_uri, '') AS key_uri, nullif(key_iv, '') AS key_iv, map_uri, map_length, map_offset FROM s""")
def m3u8_segments(spark, sf):
    return sc.media_segments(medias(spark, sf)).drop("program_date_time")


@_query("SELECT o_orderkey AS media_id, CAST(3 + o_orderkey % 4 AS INTEGER) AS version, CAST(ceil(o_totalprice / 1000) AS INTEGER) AS target_duration, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS INTEGER) AS media_sequence, CASE WHEN o_orderkey % 2 = 0 THEN 'VOD' END AS playlist_type, o_orderkey % 7 = 0 AS i_frames_only, o_orderstatus = 'F' AS end_list FROM orders")
def m3u8_header(spark, sf):
    k = F.col("o_orderkey")
    maybe = lambda c, text: F.when(c, text).otherwise(F.lit(""))
    block = F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:"), _s(F.ceil(F.col("o_totalprice") / 1000)), F.lit("\n#EXT-X-VERSION:"), _s(k % 4 + 3), F.lit("\n"), maybe(k % 3 != 0, F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), _s("o_custkey"), F.lit("\n"))), maybe(k % 2 == 0, F.lit("#EXT-X-PLAYLIST-TYPE:VOD\n")), maybe(k % 7 == 0, F.lit("#EXT-X-I-FRAMES-ONLY\n")), F.lit("#EXTINF:1,\na.ts\n"), maybe(F.col("o_orderstatus") == "F", F.lit("#EXT-X-ENDLIST\n")))
    return sc.media_header(_files(table(spark, sf, "orders"), "o_orderkey", ["o_orderkey"], block))


# --- cue sheets ---


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A cue sheet for each customer: a track for each order, a new file before each whose key is a multiple of four."""
    k = F.col("o_orderkey")
    at = k % 400000
    time = lambda c: F.concat(F.lpad(_s(F.floor(c / 4500)), 2, "0"), F.lit(":"), F.lpad(_s(F.floor(c % 4500 / 75)), 2, "0"), F.lit(":"), F.lpad(_s(c % 75), 2, "0"))
    source = F.when(k % 4 == 0, F.concat(F.lit('FILE "disc '), _s(k), F.lit('.wav" wave\n'))).otherwise(F.lit(""))
    title = F.when(k % 3 == 0, F.concat(F.lit("    TITLE  "), F.col("o_orderstatus"), F.lit(" \n"))).otherwise(F.concat(F.lit('    title "'), F.col("o_orderpriority"), F.lit('"\n')))
    before = F.when(k % 2 == 0, F.concat(F.lit("    INDEX 00 00:00:00\n    PREGAP 00:02:00\n"))).otherwise(F.lit(""))
    block = F.concat(source, F.lit("  TRACK "), F.lpad(_s(k % 99 + 1), 2, "0"), F.lit(" audio\n\n"), title, before, F.lit("    INDEX 01 "), time(at), F.lit("\n    REM "), _s(k), F.lit("\n"))
    return _files(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], block, 'REM GENRE Test\nPERFORMER "Some One"\nTITLE "All of it"\nFILE first.bin BINARY\n')


@_query("""WITH o AS (SELECT *, last_value(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END IGNORE NULLS) OVER w AS f, sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_custkey AS media_id, CAST(n + 1 AS INTEGER) AS file_no, CASE WHEN f IS NULL THEN 'first.bin' ELSE 'disc ' || f || '.wav' END AS filename, CASE WHEN f IS NULL THEN 'BINARY' ELSE 'WAVE' END AS file_type, CAST(o_orderkey % 99 + 1 AS INTEGER) AS number, 'AUDIO' AS type, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 2 = 0 THEN CAST(150 AS BIGINT) END AS pregap_frames, o_orderkey % 400000 AS start_frames FROM o""")
def cue_read(spark, sf):
    return sc.read_cue(sheets(spark, sf)).select("media_id", "file_no", "filename", "file_type", "number", "type", "title", "pregap_frames", "start_frames")


@_query("SELECT o_custkey AS media_id, 'All of it' AS title, 'Some One' AS performer, count(*) AS tracks, 1 + count(*) FILTER (WHERE o_orderkey % 4 = 0) AS files, max(o_orderkey % 400000) / CAST(75 AS DOUBLE) AS duration_s FROM orders GROUP BY o_custkey")
def cue_info(spark, sf):
    return sc.cue_info(sheets(spark, sf))


@_query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 400000 AS f FROM orders)
SELECT o_custkey AS media_id, 'PERFORMER "Customer ' || o_custkey || '"' || chr(10) || 'FILE "c' || o_custkey || '.wav" WAVE' || chr(10) || string_agg('  TRACK ' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || ' AUDIO' || chr(10) || '    TITLE "' || o_orderpriority || '"' || chr(10) || '    INDEX 01 ' || lpad(CAST(f // 4500 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f % 4500 // 75 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f % 75 AS VARCHAR), 2, '0'), chr(10) ORDER BY n) || chr(10) AS text FROM o GROUP BY o_custkey""")
def cue_write(spark, sf):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    tracks = table(spark, sf, "orders").select(F.col("o_custkey").alias("media_id"), F.concat(F.lit("c"), _s("o_custkey"), F.lit(".wav")).alias("filename"), F.lit(None).cast("string").alias("album"), F.concat(F.lit("Customer "), _s("o_custkey")).alias("artist"), number.alias("number"), F.col("o_orderpriority").alias("title"), F.lit("").alias("performer"), (F.col("o_orderkey") % 400000).alias("start_frames"))
    return sc.write_cue(tracks)


# --- subtitles and scripts ---

_MS = lambda c: F.concat(F.lpad(_s(F.floor(c / 3600)), 2, "0"), F.lit(":"), F.lpad(_s(F.floor(c % 3600 / 60)), 2, "0"), F.lit(":"), F.lpad(_s(c % 60), 2, "0"))


def subtitles(spark: SparkSession, sf: str, kind: Column | None = None) -> DataFrame:
    """Each conversation as SRT (0), VTT (1) or plain text, by its id or by kind: a cue for each turn, from 3 to 3 seconds."""
    t, kind = F.col("turn").cast("long"), F.col("conv_id") % 3 if kind is None else kind
    words = F.coalesce("text", F.lit(""))
    srt = F.concat(_s(t + 1), F.lit("\n"), _MS(t * 3), F.lit(",000 --> "), _MS(t * 3 + 2), F.lit(",500\nx "), words, F.lit("\n\n"))
    vtt = F.concat(F.when(t == 0, F.lit("WEBVTT about\n\nSTYLE\n::cue { color: red }\n\n")).otherwise(F.lit("")), F.when(t % 2 == 0, F.lit("id\n")).otherwise(F.lit("")), _MS(t * 3), F.lit(".000 --> "), _MS(t * 3 + 2), F.lit(".500  align:start position:"), _s(t), F.lit("%\nx "), words, F.lit("\n\n"))
    return _files(table(spark, sf, "conversations"), "conv_id", ["turn"], F.when(kind == 0, srt).when(kind == 1, vtt).otherwise(words))


@_query("SELECT conv_id AS media_id, CASE conv_id % 3 WHEN 0 THEN 'srt' ELSE 'vtt' END AS format, count(*) AS cues, CAST(max(turn) * 3 + 2.5 AS DOUBLE) AS duration, conv_id % 3 = 1 AS has_styles, false AS has_regions FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id")
def subtitle_info(spark, sf):
    return sc.subtitle_info(subtitles(spark, sf))


@_query("SELECT conv_id AS media_id, CASE WHEN turn % 2 = 0 THEN 'id' END AS id, 'start' AS align, turn || '%' AS position, CAST(NULL AS VARCHAR) AS region, regexp_replace('x ' || coalesce(text, ''), '\\s+$', '') AS text FROM conversations")
def vtt_settings(spark, sf):
    return sc.vtt_settings(subtitles(spark, sf, F.lit(1))).select("media_id", "id", "align", "position", "region", "text")


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    """A VTT file for each nation's region: a region or style block for each nation."""
    k = F.col("n_nationkey")
    block = F.when(k % 2 == 0, F.concat(F.lit("REGION\nlines:"), _s(k), F.lit("\nid:"), F.col("n_name"), F.lit(" width:40%\nregionanchor:0%,100%\n\n"))).otherwise(F.concat(F.lit("STYLE\n::cue("), F.col("n_name"), F.lit(") {\n color: red\n}\n\n")))
    return _files(table(spark, sf, "nation").withColumn("n_name", F.replace("n_name", F.lit(" "), F.lit("_"))), "n_regionkey", ["n_nationkey"], block, "WEBVTT\n\n")


@_query("SELECT CAST(n_regionkey AS BIGINT) AS media_id, replace(n_name, ' ', '_') AS id, '40%' AS width, n_nationkey AS lines, '0%,100%' AS regionanchor FROM nation WHERE n_nationkey % 2 = 0")
def vtt_regions(spark, sf):
    return sc.vtt_regions(_regions(spark, sf)).select("media_id", "id", "width", "lines", "regionanchor")


@_query("SELECT CAST(n_regionkey AS BIGINT) AS media_id, '::cue(' || replace(n_name, ' ', '_') || ') {' || chr(10) || ' color: red' || chr(10) || '}' AS css FROM nation WHERE n_nationkey % 2 = 1")
def vtt_styles(spark, sf):
    return sc.vtt_styles(_regions(spark, sf)).select("media_id", "css")


def ass_files(spark: SparkSession, sf: str) -> DataFrame:
    """A script for each customer: a style and a dialogue or comment for each order, under a format with its own order of fields."""
    k = F.col("o_orderkey")
    second = k % 86400
    clock = F.concat(_s(F.floor(second / 3600)), F.lit(":"), F.lpad(_s(F.floor(second % 3600 / 60)), 2, "0"), F.lit(":"), F.lpad(_s(second % 60), 2, "0"))
    style = F.concat(F.lit("\nStyle: S"), _s(k), F.lit(", Arial ,"), _s(k % 50), F.lit(",&H00"), F.lpad(F.hex(k % 16777216), 6, "0"), F.lit(","), F.when(k % 2 == 0, F.lit("-1")).otherwise(F.lit("0")), F.lit(","), _s(k % 9 + 1))
    text = F.concat(F.col("o_orderpriority"), F.lit(", {\\i1}and, so on"))
    event = F.concat(F.lit("\n"), F.when(k % 4 == 0, F.lit("Comment: ")).otherwise(F.lit("Dialogue: ")), F.lit("S"), _s(k), F.lit(","), clock, F.lit(".25,"), clock, F.lit(".75,"), _s(k % 3), F.lit(","), text)
    own = table(spark, sf, "orders").select(F.col("o_custkey").alias("media_id"), F.struct("o_orderkey", style.alias("style"), event.alias("event")).alias("b"))
    lines = own.groupBy("media_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    whole = F.concat(F.lit("[Script Info]\n; a remark\nTitle:  A script \nScriptType: v4.00+\nPlayResX: 640\nPlayResY: 360\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, Bold, Alignment"), F.array_join(F.transform("b", lambda b: b["style"]), ""), F.lit("\n\n[Events]\nFormat: Style, Start, End, Layer, Text"), F.array_join(F.transform("b", lambda b: b["event"]), ""), F.lit("\n"))
    return lines.select("media_id", F.when(F.col("media_id") % 2 == 1, F.replace(whole, F.lit("\n"), F.lit("\r\n"))).otherwise(whole).alias("text"))


def _events_sql(which: str) -> str:
    return f"SELECT o_custkey AS media_id, CAST(o_orderkey % 3 AS INTEGER) AS layer, CAST(o_orderkey % 86400 + 0.25 AS DOUBLE) AS start_s, CAST(o_orderkey % 86400 + 0.75 AS DOUBLE) AS end_s, ' S' || o_orderkey AS style, o_orderpriority || ', {{\\i1}}and, so on' AS text FROM orders WHERE o_orderkey % 4 {which} 0"


_EVENT = ("media_id", "layer", "start_s", "end_s", "style", "text")


@_query(_events_sql("<>"))
def ass_dialogues(spark, sf):
    return sc.ass_events(ass_files(spark, sf)).select(*_EVENT)


@_query(_events_sql("="))
def ass_comments(spark, sf):
    return sc.ass_events(ass_files(spark, sf), "Comment").select(*_EVENT)


@_query("SELECT o_custkey AS media_id, 'S' || o_orderkey AS name, 'Arial' AS font, CAST(o_orderkey % 50 AS DOUBLE) AS size, o_orderkey % 2 = 0 AS bold, CAST(o_orderkey % 9 + 1 AS INTEGER) AS alignment, CAST(o_orderkey % 16777216 // 65536 AS INTEGER) AS blue, CAST(o_orderkey % 65536 // 256 AS INTEGER) AS green, CAST(o_orderkey % 256 AS INTEGER) AS red, '&H00' || upper(lpad(hex(o_orderkey % 16777216), 6, '0')) AS again FROM orders")
def ass_styles(spark, sf):
    found = sc.ass_styles(ass_files(spark, sf)).withColumn("c", sc.ass_color(F.col("primary_color")))
    return found.select("media_id", "name", "font", "size", "bold", "alignment", "c.blue", "c.green", "c.red", sc.format_ass_color(*(F.col(f"c.{x}") for x in ("alpha", "blue", "green", "red"))).alias("again"))


@_query("SELECT o_custkey AS media_id, 'ass' AS format, 'A script' AS title, 640 AS width, 360 AS height, count(*) AS styles, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS dialogues, coalesce(max(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 86400 + CAST(0.75 AS DOUBLE) END), CAST(0 AS DOUBLE)) AS duration FROM orders GROUP BY o_custkey")
def ass_info(spark, sf):
    return sc.ass_info(ass_files(spark, sf))


@_query("""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\\r?\\n', '\\\\N', 'g') AS body FROM conversations WHERE text IS NOT NULL)
SELECT conv_id AS media_id, '[Script Info]' || chr(10) || 'Title: Subtitles' || chr(10) || 'ScriptType: v4.00+' || chr(10) || chr(10) || '[V4+ Styles]' || chr(10) || 'Format: Name, Fontname, Fontsize, PrimaryColour, Bold, Italic, Alignment' || chr(10) || 'Style: Default,Arial,20,&H00FFFFFF,0,0,2' || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text' || chr(10) || string_agg('Dialogue: 0,' || turn // 3600 || ':' || lpad(CAST(turn % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '.00,' || turn // 3600 || ':' || lpad(CAST(turn % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '.50,Default,,0,0,0,,' || body, chr(10) ORDER BY turn, body) || chr(10) AS text FROM c GROUP BY conv_id""")
def ass_write(spark, sf):
    cues = table(spark, sf, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("cue_no"), F.col("turn").cast("double").alias("start_s"), (F.col("turn") + 0.5).alias("end_s"), "text")
    return sc.write_ass(cues)


# --- playlists written ---


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """A playlist for each order, a segment for each line item; keys and maps that come, stay, change and go."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.row_number().over(order).alias("seq"), F.concat(F.lit("s"), _s("l_partkey"), F.lit(".ts")).alias("uri"), ((p % 97) / 8).alias("duration"), F.when(p % 2 == 0, F.concat(F.lit("Part "), _s("l_partkey"))).alias("title"), (q % 5 == 0).alias("discontinuity"),
        F.when(p % 3 != 0, F.when(p % 3 == 1, "AES-128").otherwise("NONE")).alias("key_method"), F.when(p % 3 == 1, F.concat(F.lit("k"), _s(q % 2))).alias("key_uri"), F.when(p % 4 == 0, "0xA1").alias("key_iv"),
        F.when(q % 3 == 0, F.concat(F.lit("m"), _s(p % 2))).alias("map_uri"), F.when(p % 5 < 3, p % 5 + 1).alias("map_length"), F.when(p % 5 < 2, q % 2).alias("map_offset"),
        F.when(q % 2 == 0, p).alias("byte_length"), F.when(p % 2 == 0, q).alias("byte_offset"), F.when(q % 4 == 0, F.timestamp_seconds(p * 1000 + F.lit(0.25))).alias("program_date_time"),
    )


@_query("""WITH l AS (SELECT l_orderkey AS media_id, l_partkey AS p, l_suppkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem),
t AS (SELECT *, CASE p % 3 WHEN 1 THEN '#EXT-X-KEY:METHOD=AES-128,URI="k' || q % 2 || '"' WHEN 2 THEN '#EXT-X-KEY:METHOD=NONE' END || CASE WHEN p % 4 = 0 THEN ',IV=0xA1' ELSE '' END AS k,
  CASE WHEN q % 3 = 0 THEN '#EXT-X-MAP:URI="m' || p % 2 || '"' || CASE WHEN p % 5 < 3 THEN ',BYTERANGE="' || (p % 5 + 1) || CASE WHEN p % 5 < 2 THEN '@' || q % 2 ELSE '' END || '"' ELSE '' END END AS m FROM l),
c AS (SELECT *, last_value(k IGNORE NULLS) OVER w AS k0, last_value(m IGNORE NULLS) OVER w AS m0 FROM t WINDOW w AS (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT media_id, seq, p, CASE WHEN q % 5 = 0 THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || CASE WHEN k IS DISTINCT FROM k0 AND k IS NOT NULL THEN k || chr(10) ELSE '' END || CASE WHEN m IS DISTINCT FROM m0 AND m IS NOT NULL THEN m || chr(10) ELSE '' END
  || CASE WHEN q % 4 = 0 THEN '#EXT-X-PROGRAM-DATE-TIME:' || strftime(make_timestamp(p * 1000000000 + 250000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(10) ELSE '' END || CASE WHEN q % 2 = 0 THEN '#EXT-X-BYTERANGE:' || p || CASE WHEN p % 2 = 0 THEN '@' || q ELSE '' END || chr(10) ELSE '' END
  || '#EXTINF:' || printf('%.6f', (p % 97) / CAST(8 AS DOUBLE)) || ',' || CASE WHEN p % 2 = 0 THEN 'Part ' || p ELSE '' END || chr(10) || 's' || p || '.ts' AS block FROM c)
SELECT media_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(ceil(greatest(max((p % 97) / CAST(8 AS DOUBLE)), 1)) AS BIGINT) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:7' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || string_agg(block, chr(10) ORDER BY seq) || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS text FROM b GROUP BY media_id""")
def m3u8_media_write(spark, sf):
    return playlists.write_media(_segments(spark, sf), media_sequence=7, playlist_type="VOD")


@_query("""WITH v AS (SELECT o_custkey AS media_id, o_orderkey AS k, '#EXT-X-STREAM-INF:BANDWIDTH=' || (o_orderkey * 1000) || CASE WHEN o_orderkey % 2 = 0 THEN ',AVERAGE-BANDWIDTH=' || (o_orderkey * 900) ELSE '' END || ',CODECS="avc1,' || o_orderkey % 9 || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',RESOLUTION=' || (o_orderkey % 1920 + 1) || 'x' || (o_orderkey % 1080 + 1) ELSE '' END || CASE WHEN o_orderkey % 4 <> 1 THEN ',FRAME-RATE=' || printf('%.3f', (o_orderkey % 61) / CAST(8 AS DOUBLE)) ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ',AUDIO="a' || o_custkey % 3 || '"' ELSE '' END || chr(10) || 'o' || o_orderkey || '.m3u8' AS line FROM orders),
s AS (SELECT media_id, string_agg(line, chr(10) ORDER BY k) AS streams FROM v GROUP BY media_id),
m AS (SELECT c_custkey AS media_id, '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a' || c_custkey % 3 || '",NAME="' || c_name || '",LANGUAGE="' || c_mktsegment || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',DEFAULT=YES' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ',FORCED=YES' ELSE '' END || ',CHANNELS="' || c_nationkey || '"' AS media FROM customer)
SELECT coalesce(s.media_id, m.media_id) AS media_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) || concat_ws(chr(10), media, streams) || chr(10) AS text FROM s FULL JOIN m ON s.media_id = m.media_id""")
def m3u8_master_write(spark, sf):
    k = F.col("o_orderkey")
    variants = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("media_id"), k.alias("place"), F.concat(F.lit("o"), _s("o_orderkey"), F.lit(".m3u8")).alias("uri"), (k * 1000).alias("bandwidth"), F.when(k % 2 == 0, k * 900).alias("average_bandwidth"), F.concat(F.lit("avc1,"), _s(k % 9)).alias("codecs"),
        F.when(k % 3 == 0, k % 1920 + 1).alias("width"), (k % 1080 + 1).alias("height"), F.when(k % 4 != 1, (k % 61) / 8).alias("frame_rate"), F.when(k % 5 == 0, F.concat(F.lit("a"), _s(F.col("o_custkey") % 3))).alias("audio"),
    )
    c = F.col("c_custkey")
    renditions = table(spark, sf, "customer").select(c.alias("media_id"), F.lit(1).alias("place"), F.lit("AUDIO").alias("type"), F.concat(F.lit("a"), _s(c % 3)).alias("group_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("language"), (c % 2 == 0).alias("default"), (c % 5 == 0).alias("forced"), F.col("c_nationkey").alias("channels"))
    return playlists.write_master(variants, renditions, independent_segments=True)
