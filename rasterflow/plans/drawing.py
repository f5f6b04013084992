"""Queries that draw on the 8 by 8 rasters, read their metadata and code their samples, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import draw, text
from ..operators import raster as rs
from ..sources import metadata, notes
from .views import GRID, rasters, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COLOUR = (200, 40, 90, 128)
CANVAS = f"{GRID}, cv AS (SELECT media_id, y, x, v AS r, 255 - v AS g, v AS b, 200 AS a FROM g)"


def canvas(spark: SparkSession, sf: str) -> DataFrame:
    """The gray rasters as long pixels in colour."""
    return rs.unpack(rasters(spark, sf), ("v",)).select("media_id", "y", "x", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.col("v").alias("b"), F.lit(200).alias("a"))


def _painted(source: str, inside: str, colour: tuple = COLOUR) -> str:
    *rgb, a = colour
    cols = [f"CASE WHEN {inside} THEN CAST(floor(({n}) * (CAST({a} AS DOUBLE) / 255) + {c} * (1 - CAST({a} AS DOUBLE) / 255) + 0.5) AS INTEGER) ELSE {c} END AS {c}" for c, n in zip("rgb", rgb, strict=True)]
    return f"SELECT media_id, y, x, {', '.join(cols)}, CASE WHEN {inside} THEN greatest(a, {a}) ELSE a END AS a FROM {source}"


def _shape(name: str, inside, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: draw.paint(canvas(spark, sf), inside(), COLOUR)
    SQL[name] = f"WITH {CANVAS} {_painted('cv', sql)}"


_shape("fill_rect", lambda: draw.rect(1.5, 2, 5, 4), "x >= 1 AND x < 6 AND y >= 2 AND y < 6")
_shape("fill_circle", lambda: draw.circle(3.4, 4, 2.6), "(x - 3) * (x - 3) + (y - 4) * (y - 4) <= 9")
_shape("fill_ellipse", lambda: draw.ellipse(4, 3, 3, 2), "(x - 4) * (x - 4) / CAST(9 AS DOUBLE) + (y - 3) * (y - 3) / CAST(4 AS DOUBLE) <= 1")
_shape("draw_line", lambda: draw.line(0, 1, 7, 5), "y = 1 + CAST(floor((8 * x + 6) / CAST(14 AS DOUBLE)) AS INTEGER)")
_shape("fill_polygon", lambda: draw.polygon([(1, 1), (6, 2), (4, 7), (2, 5)]), "(SELECT count(*) FILTER (WHERE xa + (y - ya) / CAST(yb - ya AS DOUBLE) * (xb - xa) < x) % 2 = 1 OR count(*) FILTER (WHERE xa + (y - ya) / CAST(yb - ya AS DOUBLE) * (xb - xa) = x) > 0 FROM (VALUES (1, 1, 6, 2), (6, 2, 4, 7), (4, 7, 2, 5), (2, 5, 1, 1)) e(xa, ya, xb, yb) WHERE y >= least(ya, yb) AND y < greatest(ya, yb))")

QUERIES["draw_rect"] = lambda spark, sf: draw.draw_rect(canvas(spark, sf), 1, 2, 6, 4, COLOUR)
_sides = ["y = 2 AND x BETWEEN 1 AND 6", "x = 6 AND y BETWEEN 2 AND 5", "y = 5 AND x BETWEEN 1 AND 6", "x = 1 AND y BETWEEN 2 AND 5"]
SQL["draw_rect"] = f"WITH {CANVAS}, s1 AS ({_painted('cv', _sides[0])}), s2 AS ({_painted('s1', _sides[1])}), s3 AS ({_painted('s2', _sides[2])}) {_painted('s3', _sides[3])}"

_ARCS = "(abs(x - 4), abs(y - 4)) IN ((3, 0), (0, 3), (1, 2), (2, 1))"
QUERIES["draw_circle"] = lambda spark, sf: draw.draw_circle(canvas(spark, sf), 4.2, 3.6, 3, COLOUR)
SQL["draw_circle"] = f"WITH {CANVAS}, once AS ({_painted('cv', _ARCS)}) {_painted('once', '(abs(x - 4), abs(y - 4)) IN ((3, 0), (0, 3))')}"



def _laid(source: str, times: str, colour: tuple = COLOUR) -> str:
    *rgb, a = colour
    cols = [f"CASE WHEN times > 0 THEN CAST(list_reduce(range(times), lambda c, i: CAST(floor({n} * (CAST({a} AS DOUBLE) / 255) + c * (1 - CAST({a} AS DOUBLE) / 255) + CAST(0.5 AS DOUBLE)) AS BIGINT), CAST({c} AS BIGINT)) AS INTEGER) ELSE {c} END AS {c}" for c, n in zip("rgb", rgb, strict=True)]
    return f"SELECT media_id, y, x, {', '.join(cols)}, CASE WHEN times > 0 THEN greatest(a, {a}) ELSE a END AS a FROM (SELECT *, {times} AS times FROM {source})"


# Each pixel of the thin line is the middle of a disc of radius 2.
QUERIES["draw_line_wide"] = lambda spark, sf: draw.draw_line(canvas(spark, sf), 7, 5, 0, 1, COLOUR, 3)
SQL["draw_line_wide"] = f"WITH {CANVAS} " + _laid("cv", "(SELECT count(*) FILTER (WHERE (x - px) * (x - px) + (y - py) * (y - py) <= 4) FROM (VALUES (7, 5), (6, 4), (5, 4), (4, 3), (3, 3), (2, 2), (1, 2), (0, 1)) p(px, py))")
# Steps of the midpoint rule for radii 3 and 2, from the top to the right.
QUERIES["draw_ellipse"] = lambda spark, sf: draw.draw_ellipse(canvas(spark, sf), 4, 3.2, 3, 2, COLOUR)
SQL["draw_ellipse"] = f"WITH {CANVAS} " + _laid("cv", "(SELECT count(*) FROM (VALUES (0, 2), (1, 2), (2, 1), (3, 0)) p(px, py), (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) q(sx, sy) WHERE x = 4 + sx * px AND y = 3 + sy * py)")

STOPS = [(0.0, (255, 0, 0, 255)), (0.5, (0, 255, 0, 128)), (1.0, (0, 0, 255, 255))]


def _gradient(name: str, position, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: draw.fill_gradient(canvas(spark, sf), position(), STOPS)
    at = [f"CASE WHEN t <= 0.5 THEN CAST(floor({low} + ({mid} - {low}) * (t / 0.5) + 0.5) AS INTEGER) ELSE CAST(floor({mid} + ({high} - {mid}) * ((t - 0.5) / 0.5) + 0.5) AS INTEGER) END AS {c}2" for c, low, mid, high in zip("rgba", *(s[1] for s in STOPS), strict=True)]
    cols = [f"CAST(floor({c}2 * (CAST(a2 AS DOUBLE) / 255) + {c} * (1 - CAST(a2 AS DOUBLE) / 255) + 0.5) AS INTEGER) AS {c}" for c in "rgb"]
    SQL[name] = f"WITH {CANVAS}, p AS (SELECT *, least(1.0, greatest(0.0, {sql})) AS t FROM (SELECT media_id, y, x, r, g, b, a FROM cv)), q AS (SELECT *, {', '.join(at)} FROM p) SELECT media_id, y, x, {', '.join(cols)}, greatest(a, a2) AS a FROM q"


_gradient("gradient_linear", lambda: draw.linear_position(0, 0, 8, 4), "(x * CAST(8 AS DOUBLE) + y * CAST(4 AS DOUBLE)) / 80")
_gradient("gradient_radial", lambda: draw.radial_position(3, 4, 4), "sqrt(CAST((x - 3) * (x - 3) + (y - 4) * (y - 4) AS DOUBLE)) / CAST(4 AS DOUBLE)")

PALETTE = [(0, 0, 0), (255, 255, 255), (200, 50, 50), (60, 180, 75), (40, 90, 200)]
QUERIES["nearest_palette"] = lambda spark, sf: canvas(spark, sf).select("media_id", "y", "x", draw.nearest_colour((F.col("r"), F.col("g"), F.col("b")), PALETTE).alias("color"))
_fars = ", ".join(f"{{'far': (r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}), 'i': {i}}}" for i, (r, g, b) in enumerate(PALETTE))
SQL["nearest_palette"] = f"WITH {CANVAS} SELECT media_id, y, x, list_sort([{_fars}])[1].i AS color FROM cv"


def flood_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rs.unpack(draw.flood_mask(rasters(spark, sf), 3, 3, ("v",), 40), ("v", "mask"))


QUERIES["flood_fill"] = flood_fill
SQL["flood_fill"] = f"""WITH RECURSIVE {GRID.replace('AS MATERIALIZED', 'AS')}, s AS MATERIALIZED (SELECT g.media_id, g.y, g.x FROM g JOIN g o ON o.media_id = g.media_id AND o.y = 3 AND o.x = 3 WHERE abs(g.v - o.v) <= 40),
reach AS (SELECT media_id, y, x FROM s WHERE y = 3 AND x = 3 UNION SELECT s.media_id, s.y, s.x FROM reach JOIN s ON s.media_id = reach.media_id AND abs(s.y - reach.y) + abs(s.x - reach.x) = 1)
SELECT g.media_id, g.y, g.x, g.v, CASE WHEN reach.x IS NULL THEN 0 ELSE 1 END AS mask FROM g LEFT JOIN reach ON reach.media_id = g.media_id AND reach.y = g.y AND reach.x = g.x"""


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata block for each order: orientation, width, and a place on earth, little-endian in even orders and big-endian in odd ones."""
    k = F.col("o_orderkey")

    def number(v, digits: int, little: bool):
        whole = F.lpad(F.hex(v.cast("long")), digits, "0")
        return F.concat(*[F.substring(whole, i, 2) for i in range(digits - 1, 0, -2)]) if little else whole

    def block(little: bool):
        n2, n4 = (lambda v: number(_lit(v), 4, little)), (lambda v: number(_lit(v), 8, little))
        _lit = lambda v: v if not isinstance(v, int) else F.lit(v)
        short = lambda tag, v: [n2(tag), n2(3), n4(1), n2(v), F.lit("0000")]
        long = lambda tag, kind, n, v: [n2(tag), n2(kind), n4(n), n4(v)]
        text = lambda tag, c: [n2(tag), n2(2), n4(2), F.lit(f"{ord(c):02X}000000")]
        head = [F.lit("4949" if little else "4D4D"), n2(42), n4(8)]
        first = [n2(3), *long(0x100, 4, 1, k % 5000), *short(0x112, k % 8 + 1), *long(0x8825, 4, 1, 50), n4(0)]
        place = [n2(4), *text(1, "S"), *long(2, 5, 3, 104), *text(3, "E"), *long(4, 5, 3, 128), n4(0)]
        angles = [n4(x) for v in (k % 90, k % 60, k % 3600, k % 180, k % 60, k % 3600) for x in (v, 1)]
        return F.unhex(F.concat(*head, *first, *place, *angles))

    return table(spark, sf, "orders").select(k.alias("media_id"), F.when(k % 2 == 0, block(True)).otherwise(block(False)).alias("content"))


QUERIES["exif_parse"] = lambda spark, sf: metadata.exif_summary(metadata.exif_entries(_tagged(spark, sf))).select("media_id", "orientation", "width", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))
SQL["exif_parse"] = "SELECT o_orderkey AS media_id, CAST(o_orderkey % 8 + 1 AS BIGINT) AS orientation, CAST(o_orderkey % 5000 AS BIGINT) AS width, round(-(o_orderkey % 90 + o_orderkey % 60 / CAST(60 AS DOUBLE) + o_orderkey % 3600 / CAST(3600 AS DOUBLE)), 6) AS latitude, round(o_orderkey % 180 + o_orderkey % 60 / CAST(60 AS DOUBLE) + o_orderkey % 3600 / CAST(3600 AS DOUBLE), 6) AS longitude FROM orders"


def wav_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    audio = table(spark, sf, "embeddings").select(F.col("vec_id").alias("media_id"), F.lit(8000).alias("sample_rate"), F.array(F.transform("embedding", lambda v: v.cast("double"))).alias("samples"))
    back = metadata.decode_audio(metadata.encode_audio(audio))
    return back.select("media_id", "sample_rate", F.posexplode(F.element_at("samples", 1)).alias("i", "sample"))


QUERIES["wav_roundtrip"] = wav_roundtrip
SQL["wav_roundtrip"] = "SELECT vec_id AS media_id, 8000 AS sample_rate, CAST(unnest(range(0, 64)) AS INTEGER) AS i, unnest(list_transform(embedding, lambda e: least(32767, greatest(-32768, floor(CAST(e AS DOUBLE) * 32767 + 0.5))) / CAST(32768 AS DOUBLE))) AS sample FROM embeddings"


# --- canvases and text ---

QUERIES["create_image"] = lambda spark, sf: draw.create_image(table(spark, sf, "nation").select(F.col("n_nationkey").alias("media_id")), 5, 3, (1, 2, 3, 4))
SQL["create_image"] = "SELECT n_nationkey AS media_id, CAST(i // 5 AS INTEGER) AS y, CAST(i % 5 AS INTEGER) AS x, 1 AS r, 2 AS g, 3 AS b, 4 AS a FROM nation CROSS JOIN (SELECT unnest(range(0, 15)) AS i)"
QUERIES["clear"] = lambda spark, sf: draw.clear(canvas(spark, sf), (9, 8, 7, 255))
SQL["clear"] = f"WITH {CANVAS} SELECT media_id, y, x, 9 AS r, 8 AS g, 7 AS b, 255 AS a FROM cv"
QUERIES["get_pixel"] = lambda spark, sf: draw.get_pixel(canvas(spark, sf), 3, 5)
SQL["get_pixel"] = f"WITH {CANVAS} SELECT media_id, r, g, b, a FROM cv WHERE x = 3 AND y = 5"
QUERIES["set_pixel"] = lambda spark, sf: draw.set_pixel(canvas(spark, sf), 2.5, 6.4, COLOUR)
SQL["set_pixel"] = f"WITH {CANVAS} {_painted('cv', 'x = 3 AND y = 6')}"

#: A made-up font for letters, digits and the question mark, which stands for all other characters.
FONT = {c: [(c * 37 + row * 11) % 256 for row in range(8)] for c in range(48, 123)}


def _text_measure(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("media_id"), F.replace("p_name", F.lit(" "), F.lit("\n")).alias("text"))
    size = text.measure_text(F.col("text"), 10, advance=8, spacing=1)
    return names.select("media_id", size.alias("s")).select("media_id", "s.width", "s.height", "s.lines")


QUERIES["text_measure"] = _text_measure
SQL["text_measure"] = "WITH l AS (SELECT p_partkey AS media_id, unnest(string_split(p_name, ' ')) AS line FROM part) SELECT media_id, CAST(max(greatest(length(line) * 9 - 1, 0)) AS INTEGER) AS width, CAST(count(*) * 10 AS INTEGER) AS height, CAST(count(*) AS INTEGER) AS lines FROM l GROUP BY media_id"


def _text_sql(align: str) -> str:
    return f"""WITH w AS (SELECT n_nationkey AS media_id, string_split(n_name || ' ' || n_nationkey, ' ') AS lines FROM nation), m AS (SELECT *, list_max(list_transform(lines, lambda x: length(x) * 8)) AS width FROM w),
l AS (SELECT media_id, width, unnest(range(0, len(lines))) AS line_no, unnest(lines) AS line FROM m), c AS (SELECT media_id, line_no, {align} AS start, unnest(range(0, length(line))) AS i, line FROM l),
g AS (SELECT media_id, line_no, start + i * 8 AS x0, CASE WHEN ascii(line[i + 1]) BETWEEN 48 AND 122 THEN ascii(line[i + 1]) ELSE 63 END AS code FROM c)
SELECT media_id, CAST(line_no * 8 + r AS INTEGER) AS y, CAST(x0 + k AS INTEGER) AS x FROM g CROSS JOIN (SELECT unnest(range(0, 8)) AS r) CROSS JOIN (SELECT unnest(range(0, 8)) AS k) WHERE ((code * 37 + r * 11) % 256 >> CAST(7 - k AS INTEGER)) & 1 = 1"""


for _align, _start in (("left", "0"), ("center", "(width - length(line) * 8) // 2"), ("right", "width - length(line) * 8")):
    QUERIES[f"text_{_align}"] = lambda spark, sf, a=_align: text.render_text(table(spark, sf, "nation").select(F.col("n_nationkey").alias("media_id"), F.concat(F.replace("n_name", F.lit(" "), F.lit("\n")), F.lit("\n"), F.col("n_nationkey").cast("string")).alias("text")), FONT, 63, a)
    SQL[f"text_{_align}"] = _text_sql(_start)


# --- colour profiles ---


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each part: a bare profile, or one within a JPEG in two segments; its tags say the part's name, size and price."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    n = lambda v, digits=8: F.lpad(F.hex(v if not isinstance(v, int) else F.lit(v)), digits, "0")
    sign = lambda s: F.lit(s.encode().hex().upper())
    name = F.hex(F.encode("p_name", "UTF-8"))
    bodies = [  # each in a slot of 64 bytes
        ("desc", F.concat(sign("desc"), n(0), n((F.length(name) / 2 + 1).cast("long")), name, F.lit("00"))),
        ("wtpt", F.concat(sign("XYZ "), n(0), n(size * 65536 + 32768), F.lit("FFFF0000"), n(k * 256))),
        ("rTRC", F.concat(sign("curv"), n(0), F.when(k % 3 == 0, n(0)).when(k % 3 == 1, F.concat(n(1), n(size, 4))).otherwise(F.concat(n(2), n(0, 4), F.lit("FFFF"))))),
        ("cprt", F.concat(sign("text"), n(0), F.hex(F.encode(F.col("p_brand"), "US-ASCII")))),
    ]
    first = 132 + 12 * len(bodies)
    table_ = [F.concat(sign(t), n(first + 64 * i), n((F.length(b) / 2).cast("long"))) for i, (t, b) in enumerate(bodies)]
    raw = F.concat(n(first + 64 * len(bodies)), F.lit("0" * 64), sign("acsp"), F.lit("0" * 176), n(len(bodies)), *table_, *[F.rpad(b, 128, "0") for _, b in bodies])
    segment = lambda no, part: F.concat(F.lit("FFE2"), n((F.length(part) / 2 + 16).cast("long"), 4), F.lit(b"ICC_PROFILE\0".hex().upper()), n(no, 2), F.lit("02"), part)
    half = lambda a, b: F.substring(raw, a, b)
    jpeg = F.concat(F.lit("FFD8"), segment(2, half(201, 2000)), F.lit("FFE00004AAAA"), segment(1, half(1, 200)), F.lit("FFDA0000"))
    return table(spark, sf, "part").select(k.alias("media_id"), F.unhex(F.when(k % 2 == 0, raw).otherwise(jpeg)).alias("content"))


QUERIES["icc_tags"] = lambda spark, sf: metadata.icc_tags(metadata.icc_profiles(_profiles(spark, sf))).withColumn("curve", F.concat_ws(",", F.transform("curve", lambda v: v.cast("int").cast("string")))).withColumn("points", F.when(F.col("curve") != "", F.col("curve"))).drop("curve")
SQL["icc_tags"] = """SELECT p_partkey AS media_id, tag, kind, CASE tag WHEN 'desc' THEN p_name WHEN 'cprt' THEN p_brand END AS text,
CASE WHEN tag = 'wtpt' THEN p_size + CAST(0.5 AS DOUBLE) END AS x, CASE WHEN tag = 'wtpt' THEN CAST(-1 AS DOUBLE) END AS y, CASE WHEN tag = 'wtpt' THEN p_partkey / CAST(256 AS DOUBLE) END AS z,
CASE WHEN tag = 'rTRC' AND p_partkey % 3 = 0 THEN CAST(1 AS DOUBLE) WHEN tag = 'rTRC' AND p_partkey % 3 = 1 THEN p_size / CAST(256 AS DOUBLE) END AS gamma, CASE WHEN tag = 'rTRC' AND p_partkey % 3 = 2 THEN '0,1' END AS points
FROM part CROSS JOIN (VALUES ('desc', 'desc'), ('wtpt', 'XYZ'), ('rTRC', 'curv'), ('cprt', 'text')) t(tag, kind)"""


# --- notes ---


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    """A file of two tracks for each user: a name and a tempo, and then a note or a bend for each event, the status left out where it repeats."""
    k = F.col("event_id")
    two = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    bend = k % 5 == 0
    spelt = F.when(bend, F.concat(F.lit("E3"), two(k % 128), F.lit("40"))).otherwise(F.concat(F.lit("93"), two(k % 128), two(k % 100)))
    last = F.lag(bend).over(Window.partitionBy("user_id").orderBy("event_id"))
    code = F.concat(notes.number_hex(k % 300000), F.when(F.coalesce(last == bend, F.lit(False)), F.substring(spelt, 3, 4)).otherwise(spelt))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), "event_id", code.alias("code"))
    body = rows.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "code"))), lambda x: x["code"]), "").alias("b"))
    name = F.hex(F.encode(F.concat(F.lit("user "), F.col("media_id").cast("string")), "UTF-8"))
    size = lambda c, digits: F.lpad(F.hex((F.length(c) / 2).cast("long")), digits, "0")
    head = F.concat(F.lit("00FF03"), size(name, 2), name, F.lit("8100FF510307A12000FF2F00"))
    notes_ = F.concat(F.col("b"), F.lit("00F003010203" + "00FF5804040218" + "08" + "00FF2F00"))
    mark = b"MTrk".hex()
    return body.select("media_id", F.unhex(F.concat(F.lit(f"{b'MThd'.hex()}00000006000100020060{mark}"), size(head, 8), head, F.lit(mark), size(notes_, 8), notes_)).alias("content"))


QUERIES["midi_parse"] = lambda spark, sf: notes.read_midi(_pieces(spark, sf))
SQL["midi_parse"] = """WITH e AS (SELECT user_id AS media_id, event_id, row_number() OVER w - 1 AS seq, event_id % 300000 AS delta, sum(event_id % 300000) OVER w AS tick FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
u AS (SELECT media_id, count(*) AS n, max(tick) AS tick FROM e GROUP BY media_id), r AS (
SELECT media_id, 1 AS track, seq, delta, tick, CASE WHEN event_id % 5 = 0 THEN 'bend' ELSE 'note_on' END AS kind, 3 AS channel, event_id % 128 AS first, CASE WHEN event_id % 5 = 0 THEN 64 ELSE event_id % 100 END AS second, CASE WHEN event_id % 5 = 0 THEN event_id % 128 END AS value, CAST(NULL AS VARCHAR) AS text FROM e
UNION ALL SELECT media_id, 1, n, 0, tick, 'sysex', NULL, 1, 2, NULL, NULL FROM u
UNION ALL SELECT media_id, 1, n + 1, 0, tick, 'time_signature', NULL, 4, 2, 4, NULL FROM u
UNION ALL SELECT media_id, 1, n + 2, 0, tick, 'end_of_track', NULL, NULL, NULL, NULL, NULL FROM u
UNION ALL SELECT media_id, 0, 0, 0, 0, 'track_name', NULL, ascii('u'), ascii('s'), NULL, 'user ' || media_id FROM u
UNION ALL SELECT media_id, 0, 1, 128, 128, 'set_tempo', NULL, 7, 161, 500000, NULL FROM u
UNION ALL SELECT media_id, 0, 2, 0, 128, 'end_of_track', NULL, NULL, NULL, NULL, NULL FROM u)
SELECT media_id, track, CAST(seq AS INTEGER) AS seq, CAST(delta AS BIGINT) AS delta, CAST(tick AS BIGINT) AS tick, kind, CAST(channel AS INTEGER) AS channel, CAST(first AS INTEGER) AS first, CAST(second AS INTEGER) AS second, CAST(value AS BIGINT) AS value, text FROM r"""
QUERIES["midi_header"] = lambda spark, sf: notes.midi_header(_pieces(spark, sf))
SQL["midi_header"] = "SELECT DISTINCT user_id AS media_id, 1 AS format, 2 AS tracks, 96 AS division FROM events"


def _written(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    events = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), (k * 300).alias("tick"), (k % 2 == 0).alias("on"), (k % 128).alias("note"), (k % 100).alias("velocity"))
    return notes.write_midi(events).select("media_id", F.hex("content").alias("hex"))


QUERIES["midi_write"] = _written
SQL["midi_write"] = """WITH e AS (SELECT user_id AS media_id, event_id, event_id * 300 - coalesce(lag(event_id * 300) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS d FROM events),
c AS (SELECT media_id, event_id, CASE WHEN d >= 2097152 THEN printf('%02X', CAST(128 + d // 2097152 AS BIGINT)) ELSE '' END || CASE WHEN d >= 16384 THEN printf('%02X', CAST(128 + d // 16384 % 128 AS BIGINT)) ELSE '' END || CASE WHEN d >= 128 THEN printf('%02X', CAST(128 + d // 128 % 128 AS BIGINT)) ELSE '' END || printf('%02X', CAST(d % 128 AS BIGINT)) || CASE WHEN event_id % 2 = 0 THEN '90' ELSE '80' END || printf('%02X', CAST(event_id % 128 AS BIGINT)) || printf('%02X', CAST(event_id % 100 AS BIGINT)) AS code FROM e),
t AS (SELECT media_id, '00FF510307A120' || string_agg(code, '' ORDER BY event_id) || '00FF2F00' AS track FROM c GROUP BY media_id)
SELECT media_id, '4D546864000000060000000101E04D54726B' || printf('%08X', CAST(length(track) // 2 AS BIGINT)) || track AS hex FROM t"""
