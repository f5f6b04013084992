"""Playlists written from rows: media playlists with keys, maps, ranges, dates and titles, and master playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of attributes in the order in which they are written, with whether their values are quoted.
VARIANT = (("bandwidth", False), ("average_bandwidth", False), ("codecs", True), ("resolution", False), ("frame_rate", False), ("hdcp_level", False), ("audio", True), ("video", True), ("subtitles", True), ("closed_captions", True))
RENDITION = (("type", False), ("group_id", True), ("name", True), ("uri", True), ("language", True), ("assoc_language", True), ("default", False), ("autoselect", False), ("forced", False), ("instream_id", True), ("characteristics", True), ("channels", True))
KEY = (("method", False), ("uri", True), ("iv", False), ("keyformat", True), ("keyformatversions", True))


def _given(df: DataFrame, name: str) -> Column:
    """The column of that name as text; null where df has none or it is empty."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    text = F.col(name).cast("string")
    return F.when(text != "", text)


def _attributes(pairs: list[tuple[str, bool, Column]]) -> Column:
    """NAME=value,NAME="value" of those that aren't null."""
    quote = lambda v, quoted: F.concat(F.lit('"'), v, F.lit('"')) if quoted else v
    return F.concat_ws(",", *[F.concat(F.lit(f"{n.upper().replace('_', '-')}="), quote(v, q)) for n, q, v in pairs])


def _range(length: Column, offset: Column) -> Column:
    return F.concat(length, F.coalesce(F.concat(F.lit("@"), offset), F.lit("")))


def write_media(segments: DataFrame, version: int = 3, media_sequence: int = 0, playlist_type: str | None = None, end_list: bool = True) -> DataFrame:
    """media_id, text from segments: media_id, seq, uri, duration, and where there are any title, discontinuity, key_method, key_uri, key_iv, key_keyformat, key_keyformatversions, map_uri, map_length, map_offset, byte_length, byte_offset, program_date_time.

    A key or map is written where it isn't the last one written. The target duration is the longest one's, rounded up, 1 at least.
    """
    get = lambda n: _given(segments, n)
    order = Window.partitionBy("media_id").orderBy("seq")
    key = F.when(get("key_method").isNotNull(), F.concat(F.lit("#EXT-X-KEY:"), _attributes([(n, q, get(f"key_{n}")) for n, q in KEY])))
    map_ = F.when(get("map_uri").isNotNull(), F.concat(F.lit("#EXT-X-MAP:"), _attributes([("uri", True, get("map_uri")), ("byterange", True, _range(get("map_length"), get("map_offset")))])))
    gap = F.when(F.col("discontinuity"), F.lit("#EXT-X-DISCONTINUITY")) if "discontinuity" in segments.columns else F.lit(None).cast("string")
    date = F.date_format("program_date_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if "program_date_time" in segments.columns else F.lit(None).cast("string")
    rows = segments.select("media_id", "seq", "duration", gap.alias("gap"), key.alias("key"), map_.alias("map"), F.concat(F.lit("#EXT-X-PROGRAM-DATE-TIME:"), date).alias("date"), F.concat(F.lit("#EXT-X-BYTERANGE:"), _range(get("byte_length"), get("byte_offset"))).alias("range"), F.concat(F.format_string("#EXTINF:%.6f,", F.col("duration").cast("double")), F.coalesce(get("title"), F.lit(""))).alias("inf"), "uri")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    changed = lambda c: F.when(~F.col(c).eqNullSafe(F.last(c, ignorenulls=True).over(before)), F.col(c))
    rows = rows.withColumns({"key": changed("key"), "map": changed("map")})
    block = F.concat_ws("\n", "gap", "key", "map", "date", "range", "inf", "uri")
    blocks = rows.groupBy("media_id").agg(F.ceil(F.greatest(F.max("duration"), F.lit(1.0))).alias("target"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    kind = f"#EXT-X-PLAYLIST-TYPE:{playlist_type}\n" if playlist_type else ""
    text = F.concat(F.lit(f"#EXTM3U\n#EXT-X-VERSION:{version}\n#EXT-X-TARGETDURATION:"), F.col("target").cast("string"), F.lit(f"\n#EXT-X-MEDIA-SEQUENCE:{media_sequence}\n{kind}"), "body", F.lit("\n#EXT-X-ENDLIST\n" if end_list else "\n"))
    return blocks.select("media_id", text.alias("text"))


def write_master(variants: DataFrame, renditions: DataFrame | None = None, version: int = 3, independent_segments: bool = False) -> DataFrame:
    """media_id, text from variants (media_id, place, uri, bandwidth and others of VARIANT, with width and height for the resolution) and renditions (media_id, place and those of RENDITION)."""

    def joined(df: DataFrame, line: Column, name: str) -> DataFrame:
        lines = df.select("media_id", F.struct("place", line.alias("line")).alias("l"))
        return lines.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias(name))

    sides = [_given(variants, n) for n in ("width", "height")]
    special = {"resolution": F.concat(sides[0], F.lit("x"), sides[1])}
    if "frame_rate" in variants.columns:
        special["frame_rate"] = F.when(F.col("frame_rate").isNotNull(), F.format_string("%.3f", F.col("frame_rate").cast("double")))
    streams = joined(variants, F.concat(F.lit("#EXT-X-STREAM-INF:"), _attributes([(n, q, special.get(n, _given(variants, n))) for n, q in VARIANT]), F.lit("\n"), F.col("uri")), "streams")
    head = f"#EXTM3U\n#EXT-X-VERSION:{version}\n" + ("#EXT-X-INDEPENDENT-SEGMENTS\n" if independent_segments else "")
    if renditions is None:
        return streams.select("media_id", F.concat(F.lit(head), "streams", F.lit("\n")).alias("text"))
    flag = lambda n: F.when(F.col(n), F.lit("YES")) if n in renditions.columns else F.lit(None).cast("string")
    pairs = [(n, q, flag(n) if n in ("default", "autoselect", "forced") else F.coalesce(_given(renditions, n), F.lit("")) if n in ("type", "group_id", "name") else _given(renditions, n)) for n, q in RENDITION]
    media = joined(renditions, F.concat(F.lit("#EXT-X-MEDIA:"), _attributes(pairs)), "media")
    return streams.join(media, "media_id", "full").select("media_id", F.concat(F.lit(head), F.concat_ws("\n", "media", "streams"), F.lit("\n")).alias("text"))
