"""Queries through codecs and over event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sniff
from ..operators import raster as rs
from ..sources import media, registry
from ..sources.byte_ranges import shared_folder
from ..streaming import media_stream, stateful
from .views import GRID, rasters, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _rgba(spark: SparkSession, sf: str) -> DataFrame:
    """The gray rasters packed as RGBA bytes."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    packed = F.unhex(F.array_join(F.transform("v", lambda v: F.concat(byte(v), byte(v), byte(v), F.lit("FF"))), ""))
    return rasters(spark, sf).select("media_id", "width", "height", packed.alias("data"))


def _roundtrip(fmt: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        back = media.decode(media.encode(_rgba(spark, sf), fmt), failfast=True)
        return back.select("media_id", "width", "height", F.upper(F.hex("data")).alias("data"))

    return run


for _fmt in media.ENCODERS:
    QUERIES[f"{_fmt}_roundtrip"] = _roundtrip(_fmt)
    SQL[f"{_fmt}_roundtrip"] = f"WITH {GRID} SELECT media_id, 8 AS width, 8 AS height, string_agg(lpad(printf('%X', v), 2, '0') || lpad(printf('%X', v), 2, '0') || lpad(printf('%X', v), 2, '0') || 'FF', '' ORDER BY y, x) AS data FROM g GROUP BY media_id"

QUERIES["pack_unpack"] = lambda spark, sf: rs.unpack(rs.pack(rs.unpack(rasters(spark, sf), ("v",)), ("v",)), ("v",))
SQL["pack_unpack"] = f"WITH {GRID} SELECT media_id, y, x, v FROM g"
QUERIES["event_windows"] = lambda spark, sf: media_stream.windowed_counts(table(spark, sf, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).withColumn("total", F.round("total", 2))
SQL["event_windows"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"


#: What the encoded files are, by their first bytes: farbfeld and PAM have no sign that is known, but PAM's text passes for none.
_SIGNS = {"bmp": "'bmp'", "png": "'png'", "pam": "NULL", "farbfeld": "NULL"}


def _sniffed(spark: SparkSession, sf: str) -> DataFrame:
    files = [media.encode(_rgba(spark, sf), f).select(F.lit(f).alias("encoder"), "media_id", "content") for f in _SIGNS]
    each = files[0]
    for other in files[1:]:
        each = each.unionByName(other)
    return each.select("encoder", "media_id", sniff.sniff(F.hex(F.substring("content", 1, 1000))).alias("format"))


QUERIES["sniff_content"] = _sniffed
SQL["sniff_content"] = "WITH e AS (SELECT vec_id AS media_id FROM embeddings) " + " UNION ALL ".join(f"SELECT '{f}' AS encoder, media_id, {want} AS format FROM e" for f, want in _SIGNS.items())
QUERIES["sniff_svg"] = lambda spark, sf: table(spark, sf, "nation").select("n_nationkey", sniff.sniff(F.hex(F.encode(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?>\n<SVG viewBox="0 0 1 1"><title>'), F.col("n_name"), F.lit("</title></SVG>"))).otherwise(F.concat(F.lit("<p>"), F.col("n_name"))), "UTF-8"))).alias("format"))
SQL["sniff_svg"] = "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'svg' END AS format FROM nation"


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream; the pattern serves a table of one file as well as a folder."""
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events[.]parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_units(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events of a type as packets, of which every fourth id starts a unit."""
    k = F.col("event_id")
    packets = _event_stream(spark, sf).select(F.col("user_id").alias("media_id"), F.col("event_type").alias("pid"), k.alias("at"), (k % 4 == 0).alias("starts"), F.encode(k.cast("string"), "UTF-8").alias("payload"), "ts")
    return stateful.run_to_end(stateful.stream_units(packets), "stream_units").withColumn("payload", F.decode("payload", "UTF-8"))


def stream_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as polls of a playlist of three segments whose first number goes up and down."""
    first = F.col("event_id") % 1000
    segment = lambda i: F.concat(F.lit("#EXTINF:"), ((first + i) % 4).cast("string"), F.lit(".5,\ns"), (first + i).cast("string"), F.lit(".ts\n"))
    text = F.concat(F.lit("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:"), first.cast("string"), F.lit("\n"), *map(segment, range(3)))
    polls = _event_stream(spark, sf).select(F.col("user_id").alias("media_id"), "ts", text.alias("text"))
    return stateful.run_to_end(stateful.new_segments(polls), "stream_segments").withColumn("polled_at", F.date_format("polled_at", "yyyy-MM-dd HH:mm:ss"))


QUERIES |= {f.__name__: f for f in (stream_units, stream_segments)}
SQL["stream_units"] = """WITH e AS (SELECT user_id, event_type, event_id, ts, sum(CAST(event_id % 4 = 0 AS INT)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS unit, max(ts) OVER (PARTITION BY user_id, event_type) AS last_ts, max(ts) OVER () - INTERVAL 1 MINUTE AS mark FROM events),
u AS (SELECT user_id, event_type, unit, min(event_id) AS first_id, CAST(count(*) AS INTEGER) AS packets, string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) AS payload, any_value(last_ts) AS last_ts, any_value(mark) AS mark FROM e WHERE unit > 0 GROUP BY ALL)
SELECT user_id AS media_id, event_type AS pid, first_id AS "at", packets, payload FROM u QUALIFY unit < max(unit) OVER (PARTITION BY user_id, event_type) OR last_ts + INTERVAL 10 MINUTE <= mark"""
SQL["stream_segments"] = """WITH p AS (SELECT user_id, ts, event_id % 1000 AS first, max(event_id % 1000 + 2) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id % 1000 AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM events),
s AS (SELECT user_id, ts, known, unnest(range(first, first + 3)) AS sequence FROM p)
SELECT user_id AS media_id, sequence, 's' || sequence || '.ts' AS uri, sequence % 4 + CAST(0.5 AS DOUBLE) AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS polled_at FROM s WHERE sequence > coalesce(known, -1)"""


def media_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The rasters as PNG files under ids with slashes and spaces, written by the sink and read back."""
    folder = shared_folder(spark, "media_sink")
    spark.dataSource.register(media.MediaSink)
    named = _rgba(spark, sf).withColumn("media_id", F.concat(F.lit("set a/"), F.col("media_id").cast("string"), F.lit("+%é")))
    media.encode(named, "png").write.format("media").mode("append").save(folder)
    back = media.decode(media.read_media(spark, folder), failfast=True)
    return back.select(media.file_id(F.col("media_id")).alias("media_id"), "width", "height", F.upper(F.hex("data")).alias("data"))


QUERIES["media_sink"] = media_sink
SQL["media_sink"] = SQL["png_roundtrip"].replace("SELECT media_id, 8", "SELECT 'set a/' || media_id || '+%é' AS media_id, 8")


_KINDS = ("bmp", "png", "pam", "farbfeld")


def mixed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The rasters as files of four formats by their id, one in five of them cut short, and one in seven of something else; formats are told from the bytes."""
    own, k = _rgba(spark, sf), F.col("media_id")
    files = None
    for i, fmt in enumerate(_KINDS):
        part = media.encode(own.where(k % 4 == i), fmt)
        files = part if files is None else files.unionByName(part)
    short = F.when(k % 5 == 0, F.substring("content", F.lit(1), (F.length("content") / 2).cast("int"))).otherwise(F.col("content"))
    content = F.when(k % 14 == 0, F.encode(F.lit("neither this nor that"), "UTF-8")).when(k % 14 == 7, F.encode(F.lit("GIF89a and no more"), "UTF-8")).otherwise(short)
    return files.select("media_id", content.alias("content")).withColumn("format", media.format_of(F.col("content")))


def convert_mixed(spark: SparkSession, sf: str) -> DataFrame:
    done = registry.convert(mixed_files(spark, sf), "farbfeld")
    back = media.decode(done.where("success"), failfast=True).select("media_id", F.upper(F.hex("data")).alias("data"))
    return done.drop("content", "error").join(back, "media_id", "left")


def info_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return registry.show_info(mixed_files(spark, sf)).drop("length", "error")


QUERIES |= {f.__name__: f for f in (convert_mixed, info_mixed)}
_WRONG = "CASE WHEN media_id % 14 = 0 THEN 'unknown_format' WHEN media_id % 14 = 7 THEN 'no_decoder' WHEN media_id % 5 = 0 THEN 'broken' END"
SQL["convert_mixed"] = f"WITH t AS ({SQL['png_roundtrip']}), w AS (SELECT media_id, data, {_WRONG} AS error_kind FROM t) SELECT media_id, error_kind IS NULL AS success, error_kind, CASE WHEN error_kind IS NULL THEN 'farbfeld' END AS format, CASE WHEN error_kind IS NULL THEN data END AS data FROM w"
SQL["info_mixed"] = f"WITH w AS (SELECT vec_id AS media_id, {_WRONG.replace('media_id', 'vec_id')} AS error_kind FROM embeddings) SELECT media_id, error_kind IS NULL AS success, error_kind, CASE WHEN error_kind IS NULL THEN 8 END AS width, CASE WHEN error_kind IS NULL THEN 8 END AS height, CASE WHEN error_kind IS NULL THEN true END AS opaque FROM w"
