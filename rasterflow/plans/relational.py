"""Queries over timed text, playlists, cue sheets, notes, samples and names, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as sm
from ..functions import sniff
from ..functions import timecode as tc
from ..operators import timed
from .views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(fn):
        name = fn.__name__.strip("_")
        QUERIES[name] = fn
        SQL[name] = sql
        return fn

    return add


def cues(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a subtitle file: a cue for each turn, lines and blank lines of its text joined; of a turn's several texts the smallest."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("media_id"), (F.col("turn") + 1).cast("int").alias("cue_no"), (F.col("turn") * 2.5).cast("double").alias("start_s"), (F.col("turn") * 2.5 + 2.125).cast("double").alias("end_s"), text.alias("text")).where("text <> ''").groupBy("media_id", "cue_no", "start_s", "end_s").agg(F.min("text").alias("text"))


CUES = r"""cues AS (SELECT media_id, cue_no, start_s, end_s, min(text) AS text FROM (SELECT conv_id AS media_id, CAST(turn + 1 AS INTEGER) AS cue_no, CAST(turn * 2.5 AS DOUBLE) AS start_s, CAST(turn * 2.5 + 2.125 AS DOUBLE) AS end_s, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL) WHERE text <> '' GROUP BY media_id, cue_no, start_s, end_s),
clock AS (SELECT *, floor(start_s) AS s, floor(end_s) AS e FROM cues)"""


def _clock(seconds: str, whole: str, mark: str) -> str:
    two = lambda x: f"lpad(CAST(CAST({x} AS BIGINT) AS VARCHAR), 2, '0')"
    return f"{two(f'floor({whole} / 3600)')} || ':' || {two(f'floor({whole} % 3600 / 60)')} || ':' || {two(f'{whole} % 60')} || '{mark}' || lpad(CAST(CAST(floor(({seconds} - {whole}) * 1000 + 0.5) AS BIGINT) AS VARCHAR), 3, '0')"


@_query(f"WITH {CUES} SELECT media_id, string_agg(cue_no || chr(10) || {_clock('start_s', 's', ',')} || ' --> ' || {_clock('end_s', 'e', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_no) || chr(10) AS text FROM clock GROUP BY media_id")
def srt_write(spark, sf):
    return timed.write_srt(cues(spark, sf))


@_query(f"WITH {CUES} SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('start_s', 's', '.')} || ' --> ' || {_clock('end_s', 'e', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_no) || chr(10) AS text FROM clock GROUP BY media_id")
def srt_to_vtt(spark, sf):
    return timed.write_vtt(timed.read_srt(timed.write_srt(cues(spark, sf))).withColumn("cue_no", F.col("block_no")))


@_query(f"WITH {CUES} SELECT media_id, cue_no AS idx, start_s, end_s, text FROM cues")
def srt_parse(spark, sf):
    return timed.read_srt(timed.write_srt(cues(spark, sf))).drop("block_no")


@_query(f"WITH {CUES} SELECT media_id, start_s, end_s, text FROM cues")
def vtt_parse(spark, sf):
    return timed.read_vtt(timed.write_vtt(cues(spark, sf))).select("media_id", "start_s", "end_s", "text")


@_query("SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text, '{', ''), '\\{[^}]*\\}', '', 'g'), '\\\\[nN]', chr(10), 'g') AS plain FROM conversations")
def ass_strip_tags(spark, sf):
    tagged = F.concat(F.lit("{\\b1}"), F.regexp_replace("text", r"\{", ""), F.lit("{\\i0}"))
    return table(spark, sf, "conversations").select("conv_id", "turn", timed.ass_plain(tagged).alias("plain"))


@_query("""SELECT event_id, value, t, m, CAST(h AS DOUBLE) * 3600 + CAST(mm AS DOUBLE) * 60 + CAST(ss AS DOUBLE) + CAST(cs AS DOUBLE) / 100 AS seconds FROM (
SELECT event_id, value, h || ':' || lpad(mm, 2, '0') || ':' || lpad(ss, 2, '0') || '.' || lpad(cs, 2, '0') AS t, m, h, mm, ss, cs FROM (
SELECT event_id, value, event_id % 30000 AS m, CAST(m // 3600 AS VARCHAR) AS h, CAST(m % 3600 // 60 AS VARCHAR) AS mm, CAST(m % 60 AS VARCHAR) AS ss, '25' AS cs FROM events))""")
def ass_time(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", (F.col("event_id") % 30000).alias("m"))
    return df.withColumn("t", tc.format_ass_time(F.col("m") + 0.25)).withColumn("seconds", tc.parse_ass_time(F.col("t")))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a playlist, a segment for each line item."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    key = F.when(F.col("l_returnflag") == "N", "NONE").otherwise("AES-128")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("media_id"), place.alias("seq"), F.concat(F.lit("seg"), F.col("l_linenumber").cast("string"), F.lit(".ts")).alias("uri"), (F.col("l_quantity") / 4).alias("duration"), (F.col("l_linestatus") == "F").alias("discontinuity"), key.alias("key"))


SEGMENTS = "seg AS (SELECT l_orderkey AS media_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq, 'seg' || l_linenumber || '.ts' AS uri, l_quantity / 4 AS duration, l_linestatus = 'F' AS discontinuity, CASE WHEN l_returnflag = 'N' THEN 'NONE' ELSE 'AES-128' END AS key FROM lineitem)"
_RUN = "run AS (SELECT *, lag(key) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM seg), ch AS (SELECT *, CASE WHEN before IS NULL THEN key <> 'NONE' ELSE before <> key END AS changed FROM run)"


@_query(f"WITH {SEGMENTS}, {_RUN} SELECT media_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(ceil(greatest(max(duration), 1)) AS BIGINT) || chr(10) || string_agg(CASE WHEN discontinuity THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || CASE WHEN changed THEN '#EXT-X-KEY:METHOD=' || key || chr(10) ELSE '' END || '#EXTINF:' || printf('%.6f', duration) || ',' || chr(10) || uri, chr(10) ORDER BY seq) || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS text FROM ch GROUP BY media_id")
def m3u8_write(spark, sf):
    return timed.write_playlist(segments(spark, sf))


@_query(f"WITH {SEGMENTS}, k AS (SELECT *, sum(CASE WHEN key <> 'NONE' THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY seq) AS seen FROM seg) SELECT media_id, CAST(seq AS INTEGER) AS seq, uri, duration, '' AS title, discontinuity, CASE WHEN seen = 0 THEN NULL ELSE key END AS key FROM k")
def m3u8_media(spark, sf):
    return timed.playlist_segments(timed.write_playlist(segments(spark, sf)))


@_query(f"WITH {SEGMENTS} SELECT media_id, count(*) AS segments, round(sum(duration), 6) AS duration, false AS live, bool_or(key <> 'NONE') AS encrypted FROM seg GROUP BY media_id")
def m3u8_info(spark, sf):
    return timed.playlist_info(timed.write_playlist(segments(spark, sf)))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer as a sheet, a track for each order; starts add up from the prices."""
    from pyspark.sql import Window

    order = Window.partitionBy("media_id").orderBy("o_orderdate", "o_orderkey")
    frames = F.floor(F.col("o_totalprice") / 100).cast("long")
    df = table(spark, sf, "orders").withColumn("media_id", F.col("o_custkey"))
    return df.select("media_id", F.row_number().over(order).alias("number"), (F.sum(frames).over(order) - frames).alias("start_frames"), F.col("o_orderpriority").alias("title"))


TRACKS = "tr AS (SELECT o_custkey AS media_id, CAST(row_number() OVER w AS INTEGER) AS number, CAST(sum(CAST(floor(o_totalprice / 100) AS BIGINT)) OVER w - CAST(floor(o_totalprice / 100) AS BIGINT) AS BIGINT) AS start_frames, o_orderpriority AS title FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_CUE_TIME = "lpad(CAST({f} // 4500 AS VARCHAR), 2, '0') || ':' || lpad(CAST({f} % 4500 // 75 AS VARCHAR), 2, '0') || ':' || lpad(CAST({f} % 75 AS VARCHAR), 2, '0')"


@_query(f"WITH {TRACKS}, small AS (SELECT *, start_frames % 400000 AS f FROM tr) SELECT media_id, number, f, {_CUE_TIME.replace('{f}', 'f')} AS time, f AS parsed FROM small")
def cue_time(spark, sf):
    df = tracks(spark, sf).select("media_id", "number", (F.col("start_frames") % 400000).alias("f"))
    return df.withColumn("time", tc.format_cue(F.col("f"))).withColumn("parsed", tc.parse_cue(F.col("time")))


@_query(f"WITH {TRACKS} SELECT media_id, number, start_frames, title, CAST(lead(start_frames) OVER (PARTITION BY media_id ORDER BY number) - start_frames AS DOUBLE) / 75 AS duration_s FROM tr")
def cue_track_durations(spark, sf):
    return timed.track_durations(tracks(spark, sf))


@_query(f"WITH {TRACKS} SELECT media_id % 10 AS \"group\", media_id, CAST(row_number() OVER (PARTITION BY media_id % 10 ORDER BY media_id, number) AS INTEGER) AS number, start_frames, title FROM tr")
def cue_merge(spark, sf):
    return timed.merge_sheets(tracks(spark, sf).withColumn("group", F.col("media_id") % 10))


@_query(f"WITH {TRACKS} SELECT media_id, number, greatest(0, start_frames - 150) AS start_frames, title FROM tr")
def cue_offset(spark, sf):
    return timed.offset_tracks(tracks(spark, sf), -2.0)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Each user as a piece: a note for each event."""
    return table(spark, sf, "events").select(F.col("user_id").alias("media_id"), (F.col("event_id") % 128).alias("note"), F.lit(100).alias("velocity"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") % 7 * 10 + 10).alias("length"))


@_query("""WITH n AS (SELECT user_id AS media_id, event_id % 128 AS note, event_id * 10 AS start, event_id % 7 * 10 + 10 AS length FROM events),
e AS (SELECT media_id, start AS tick, true AS "on", note, 100 AS velocity FROM n UNION ALL SELECT media_id, start + length, false, note, 0 FROM n)
SELECT *, CAST(row_number() OVER w AS INTEGER) AS seq, tick - coalesce(lag(tick) OVER w, 0) AS delta FROM e WINDOW w AS (PARTITION BY media_id ORDER BY tick, "on", note, velocity)""")
def midi_note_events(spark, sf):
    return timed.note_events(notes(spark, sf))


@_query("""WITH t AS (SELECT user_id AS media_id, event_id AS tick, 300000 + event_id % 1000 * 100 AS micros FROM events WHERE event_type = 'signup'), l AS (SELECT user_id AS media_id, max(event_id) AS last_tick FROM events GROUP BY user_id),
s AS (SELECT *, coalesce(lag(micros) OVER w, 500000) AS before, coalesce(lag(tick) OVER w, 0) AS since FROM t WINDOW w AS (PARTITION BY media_id ORDER BY tick)), d AS (SELECT media_id, sum((tick - since) * before) AS done, max(tick) AS t1, arg_max(micros, tick) AS m1 FROM s GROUP BY media_id)
SELECT l.media_id, CAST(coalesce(done, 0) + greatest(0, last_tick - coalesce(t1, 0)) * coalesce(m1, 500000) AS DOUBLE) / 480000000.0 AS seconds FROM l LEFT JOIN d USING (media_id)""")
def midi_tempo_map(spark, sf):
    events = table(spark, sf, "events")
    tempos = events.where("event_type = 'signup'").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("tick"), (F.lit(300000) + F.col("event_id") % 1000 * 100).alias("micros"))
    return timed.tempo_seconds(tempos, events.groupBy(F.col("user_id").alias("media_id")).agg(F.max("event_id").alias("last_tick")))


_NAMES = "['" + "', '".join(tc.NOTES) + "']"


@_query(f"SELECT event_id, {_NAMES}[event_id % 128 % 12 + 1] || CAST(event_id % 128 // 12 - 1 AS VARCHAR) AS name, CAST(event_id % 128 AS INTEGER) AS number FROM events")
def note_name(spark, sf):
    df = table(spark, sf, "events").select("event_id")
    return df.withColumn("name", tc.note_name(F.col("event_id") % 128)).withColumn("number", tc.note_number(F.col("name")))


@_query("""WITH p AS (SELECT user_id AS media_id, event_id, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS s, length(props) AS size FROM events), u AS (SELECT *, sum(s) OVER (PARTITION BY media_id ORDER BY event_id) AS unit FROM p)
SELECT media_id, CAST(unit AS BIGINT) AS unit, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM u WHERE unit > 0 GROUP BY media_id, unit""")
def pes_reassembly(spark, sf):
    return timed.reassemble(table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("start"), F.length("props").alias("size")))


@_query("""WITH s AS (SELECT user_id AS media_id, event_id // 8 AS page, event_id % 8 AS i, CASE WHEN event_id % 3 = 0 THEN event_id % 255 ELSE 255 END AS size FROM events), n AS (SELECT *, sum(CASE WHEN size < 255 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY page, i) - CASE WHEN size < 255 THEN 1 ELSE 0 END AS packet FROM s)
SELECT media_id, CAST(packet AS BIGINT) AS packet, CAST(sum(size) AS BIGINT) AS bytes, max(page) - min(page) + 1 AS pages, min(size) < 255 AS complete FROM n GROUP BY media_id, packet""")
def laced_packets(spark, sf):
    k = F.col("event_id")
    return timed.laced_packets(table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.floor(k / 8).alias("page"), (k % 8).alias("i"), F.when(k % 3 == 0, k % 255).otherwise(255).alias("size")))


@_query("""WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM events)
SELECT user_id AS media_id, event_id AS seq, (coalesce(head * 1000, 0) + event_id % 500) * CAST(1000000 AS DOUBLE) / 1000000000 AS seconds FROM e WHERE event_type <> 'signup'""")
def cluster_times(spark, sf):
    head = F.col("event_type") == "signup"
    return timed.cluster_times(table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), F.when(head, F.col("event_id") * 1000).alias("cluster"), (F.col("event_id") % 500).alias("relative")))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as 64 samples of 16 bits."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("media_id"), F.posexplode("embedding").alias("i", "e")).select("media_id", "i", F.floor(F.col("e").cast("double") * 32767).cast("long").alias("sample"))


SIGNAL = "sg AS (SELECT vec_id AS media_id, CAST(unnest(range(0, 64)) AS INTEGER) AS i, unnest(embedding) AS e FROM embeddings), s AS (SELECT media_id, i, CAST(floor(CAST(e AS DOUBLE) * 32767) AS BIGINT) AS sample FROM sg)"


@_query(f"WITH {SIGNAL} SELECT media_id, i, sample, sample - 2 * lag(sample, 1) OVER w + lag(sample, 2) OVER w AS residual FROM s WINDOW w AS (PARTITION BY media_id ORDER BY i)")
def fixed_prediction(spark, sf):
    return timed.fixed_prediction(signal(spark, sf), 2)


@_query(f"WITH {SIGNAL} SELECT media_id, i, sample, avg(sample) OVER (PARTITION BY media_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS mean FROM s")
def moving_average(spark, sf):
    return timed.moving_average(signal(spark, sf))


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 256).cast("int").alias("lo"), (F.col("l_suppkey") % 256).cast("int").alias("hi"))


_BYTES = "b AS (SELECT CAST(l_partkey % 256 AS INTEGER) AS lo, CAST(l_suppkey % 256 AS INTEGER) AS hi FROM lineitem)"


@_query(f"WITH {_BYTES} SELECT lo, hi, CAST(CASE WHEN lo + hi * 256 >= 32768 THEN lo + hi * 256 - 65536 ELSE lo + hi * 256 END AS DOUBLE) / 32768 AS sample FROM b")
def pcm_i16_decode(spark, sf):
    return _bytes(spark, sf).withColumn("sample", sm.pcm_s16(F.col("lo"), F.col("hi")))


@_query(f"WITH {_BYTES}, u AS (SELECT lo, xor(lo, 255) AS u FROM b), m AS (SELECT lo, u, ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132 AS m FROM u) SELECT lo, CAST(CASE WHEN u & 128 <> 0 THEN -m ELSE m END AS INTEGER) AS sample FROM m")
def mulaw_decode(spark, sf):
    return _bytes(spark, sf).select("lo", sm.mulaw(F.col("lo")).alias("sample"))


@_query(f"WITH {_BYTES}, u AS (SELECT lo, xor(lo, 85) AS u FROM b), m AS (SELECT lo, u, CASE WHEN (u >> 4) & 7 = 0 THEN ((u & 15) << 4) + 8 ELSE (((u & 15) << 4) + 264) << (((u >> 4) & 7) - 1) END AS m FROM u) SELECT lo, CAST(CASE WHEN u & 128 <> 0 THEN -m ELSE m END AS INTEGER) AS sample FROM m")
def alaw_decode(spark, sf):
    return _bytes(spark, sf).select("lo", sm.alaw(F.col("lo")).alias("sample"))


_CH = "CAST(least(255, greatest(0, floor({x} + 0.5))) AS INTEGER)"


def _ch(x: str) -> str:
    return _CH.replace("{x}", x)


def _three(spark: SparkSession, sf: str) -> DataFrame:
    """Three bytes of each line item that vary on their own."""
    return table(spark, sf, "lineitem").select(*[(F.col(c) % 256).cast("int").alias(n) for n, c in zip("xyz", ("l_partkey", "l_suppkey", "l_orderkey"), strict=True)])


_THREE = "b AS (SELECT CAST(l_partkey % 256 AS INTEGER) AS x, CAST(l_suppkey % 256 AS INTEGER) AS y, CAST(l_orderkey % 256 AS INTEGER) AS z FROM lineitem)"


def _matrix(name: str, out: str, run, *rows: tuple) -> None:
    """A query of three channels from three, each a sum of (factor, channel less what comes off it) and a constant."""
    sums = [" + ".join(f"CAST({f} AS DOUBLE) * ({c} - {off})" for f, c, off in terms) + f" + {more}" for terms, more in rows]
    QUERIES[name] = lambda spark, sf: _three(spark, sf).select("x", "y", "z", *[c.alias(n) for n, c in zip(out, run(*map(F.col, "xyz")), strict=True)])
    SQL[name] = f"WITH {_THREE} SELECT x, y, z, " + ", ".join(f"{_ch(s)} AS {n}" for n, s in zip(out, sums, strict=True)) + " FROM b"


_matrix("yuv_rgb", "rgb", sm.yuv_to_rgb, ([(1.164, "x", 16), (1.596, "z", 128)], 0), ([(1.164, "x", 16), (-0.392, "y", 128), (-0.813, "z", 128)], 0), ([(1.164, "x", 16), (2.017, "y", 128)], 0))
_matrix("rgb_yuv", ("luma", "u", "v"), sm.rgb_to_yuv, ([(0.257, "x", 0), (0.504, "y", 0), (0.098, "z", 0)], 16), ([(-0.148, "x", 0), (-0.291, "y", 0), (0.439, "z", 0)], 128), ([(0.439, "x", 0), (-0.368, "y", 0), (-0.071, "z", 0)], 128))
_matrix("ycbcr_rgb", "rgb", sm.ycbcr_to_rgb, ([(1, "x", 0), (1.402, "z", 128)], 0), ([(1, "x", 0), (-0.344136, "y", 128), (-0.714136, "z", 128)], 0), ([(1, "x", 0), (1.772, "y", 128)], 0))
_matrix("rgb_ycbcr", ("luma", "cb", "cr"), sm.rgb_to_ycbcr, ([(0.299, "x", 0), (0.587, "y", 0), (0.114, "z", 0)], 0), ([(-0.168736, "x", 0), (-0.331264, "y", 0), (0.5, "z", 0)], 128), ([(0.5, "x", 0), (-0.418688, "y", 0), (-0.081312, "z", 0)], 128))


@_query(f"WITH {_BYTES} SELECT lo, hi, CASE WHEN hi = 0 THEN 0.0 ELSE lo * pow(CAST(2 AS DOUBLE), hi - 136) END AS linear FROM b")
def rgbe_rgb(spark, sf):
    return _bytes(spark, sf).select("lo", "hi", sm.rgbe(F.col("lo"), F.col("hi")).alias("linear"))


_LINEAR = "(lo * hi / CAST(4096 AS DOUBLE))"
_MAPPED = f"({_LINEAR} / (1 + {_LINEAR}))"


@_query(f"WITH {_BYTES} SELECT lo, hi, {_ch(f'255 * {_MAPPED}')} AS v FROM b")
def reinhard(spark, sf):
    return _bytes(spark, sf).select("lo", "hi", sm.reinhard(F.col("lo") * F.col("hi") / 4096).alias("v"))


@_query(f"WITH {_BYTES}, m AS (SELECT lo, hi, {_MAPPED} AS m FROM b) SELECT lo, hi, {_ch('255 * CASE WHEN m <= CAST(0.0031308 AS DOUBLE) THEN m * CAST(12.92 AS DOUBLE) ELSE CAST(1.055 AS DOUBLE) * pow(m, 1 / CAST(2.4 AS DOUBLE)) - CAST(0.055 AS DOUBLE) END')} AS v FROM m")
def hdr_tone(spark, sf):
    return _bytes(spark, sf).select("lo", "hi", sm.hdr_tone(F.col("lo") * F.col("hi") / 4096).alias("v"))


# --- types and names ---

_HEADS = ("89504E470D0A1A0A", "FFD8FFE000104A46", "474946383961", "424D3600", "1A45DFA3", "49492A00", "4D4D002A", "00000100", "716F6966", "52494646AAAAAAAA57454250", "52494646AAAAAAAA41564920", "0000001866747970617669660000", "00000018667479707174202000", "000000186674797069736F6D00", "50360A", "0011223344")
_FOUND = ("png", "jpeg", "gif", "bmp", "webm", "tiff", "tiff", "ico", "qoi", "webp", "avi", "avif", "mov", "mp4", "ppm", None)


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("page_id") % len(_HEADS) + 1).cast("int")).alias("head"))


_LISTED = ", ".join("NULL" if f is None else f"'{f}'" for f in _FOUND)


@_query(f"SELECT page_id, ['{"', '".join(_HEADS)}'][page_id % 16 + 1] AS head, [{_LISTED}][page_id % 16 + 1] AS format FROM pages")
def sniff_format(spark, sf):
    return _heads(spark, sf).withColumn("format", sniff.sniff(F.col("head")))


_MIMES = ", ".join("NULL" if f is None else f"'{'image' if f in sniff.IMAGES else 'video'}/{f}'" for f in _FOUND)


@_query(f"SELECT page_id, [{_MIMES}][page_id % 16 + 1] AS mime FROM pages")
def mime_type(spark, sf):
    return _heads(spark, sf).select("page_id", sniff.mime_type(sniff.sniff(F.col("head"))).alias("mime"))


@_query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/]*\.com/en/[^/]*$')")
def glob_filter(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").rlike(sniff.glob_regex("http*://*.com/en/*")) & F.col("url").rlike("^https?:")).select("page_id", "url")


@_query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def skip_existing_antijoin(spark, sf):
    jobs = table(spark, sf, "pages").select("page_id", "url")
    return jobs.join(jobs.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id", "url")


@_query("SELECT l_shipdate, n, color FROM (SELECT l_shipdate, color, count(*) AS n, row_number() OVER (PARTITION BY l_shipdate ORDER BY count(*) DESC, color) AS place FROM (SELECT l_returnflag AS l_shipdate, l_partkey % 256 // 16 * 256 + l_suppkey % 256 // 16 * 16 + CAST(l_quantity AS BIGINT) * 5 // 16 AS color FROM lineitem) GROUP BY l_shipdate, color) WHERE place <= 16")
def palette_topk(spark, sf):
    from pyspark.sql import Window

    colour = F.floor(F.col("l_partkey") % 256 / 16) * 256 + F.floor(F.col("l_suppkey") % 256 / 16) * 16 + F.floor(F.col("l_quantity").cast("long") * 5 / 16)
    counts = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("l_shipdate"), colour.alias("color")).groupBy("l_shipdate", "color").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("l_shipdate").orderBy(F.desc("n"), "color"))).where("place <= 16").drop("place")
