"""Queries over planes of raw video on images with odd sides, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planar
from ..operators import raster as rs
from .palettes import _PICTURES, pictures
from .views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PX = _PICTURES.split(",\nc0 AS")[0]
_ROUND = "CAST(least(255, greatest(0, floor({} + CAST(0.5 AS DOUBLE)))) AS INTEGER)"


def _sum(*terms: tuple[float, str], more: int = 0) -> str:
    return _ROUND.format(" + ".join(f"CAST({f} AS DOUBLE) * ({c})" for f, c in terms) + f" + {more}")


_CODED = f"co AS (SELECT media_id, y, x, {_sum((0.257, 'r'), (0.504, 'g'), (0.098, 'b'), more=16)} AS luma, {_sum((-0.148, 'r'), (-0.291, 'g'), (0.439, 'b'), more=128)} AS u, {_sum((0.439, 'r'), (-0.368, 'g'), (-0.071, 'b'), more=128)} AS v FROM px)"
for _layout, (_across, _down) in planar.SHARED.items():
    _chroma = f"ch AS (SELECT media_id, y // {_down} AS y, x // {_across} AS x, CAST(floor(avg(u) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS u, CAST(floor(avg(v) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS v FROM co GROUP BY ALL)"
    QUERIES[f"yuv{_layout}_planes"] = lambda spark, sf, layout=_layout: planar.to_planes(pictures(spark, sf), layout)
    SQL[f"yuv{_layout}_planes"] = f"WITH {_PX}, {_CODED}, {_chroma}, al AS (SELECT media_id, 0 AS plane, y, x, luma AS value FROM co UNION ALL SELECT media_id, 1, y, x, u FROM ch UNION ALL SELECT media_id, 2, y, x, v FROM ch) SELECT media_id, plane, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, value FROM al"
    QUERIES[f"yuv{_layout}_pixels"] = lambda spark, sf, layout=_layout: planar.to_pixels(planar.to_planes(pictures(spark, sf), layout), layout)
    SQL[f"yuv{_layout}_pixels"] = f"WITH {_PX}, {_CODED}, {_chroma} SELECT co.media_id, CAST(co.y AS INTEGER) AS y, CAST(co.x AS INTEGER) AS x, {_sum((1.164, 'luma - 16'), (1.596, 'ch.v - 128'))} AS r, {_sum((1.164, 'luma - 16'), (-0.392, 'ch.u - 128'), (-0.813, 'ch.v - 128'))} AS g, {_sum((1.164, 'luma - 16'), (2.017, 'ch.u - 128'))} AS b FROM co JOIN ch ON ch.media_id = co.media_id AND ch.y = co.y // {_down} AND ch.x = co.x // {_across}"


def yuv_read(spark: SparkSession, sf: str) -> DataFrame:
    """The planes of 4:2:0 as raw frames, and read back with their sides; a last row that isn't whole is left out."""
    whole = pictures(spark, sf).join(pictures(spark, sf).groupBy("media_id").agg(F.floor(F.count(F.lit(1)) / 25).cast("int").alias("height")), "media_id").where("y < height")
    frames = planar.frame_bytes(planar.to_planes(whole, "420"))
    sides = whole.select("media_id", F.lit(25).alias("width"), "height").distinct()
    return planar.read_planes(frames.join(sides, "media_id"), "420")


QUERIES["yuv_read"] = yuv_read
_chroma = "ch AS (SELECT media_id, y // 2 AS y, x // 2 AS x, CAST(floor(avg(u) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS u, CAST(floor(avg(v) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS v FROM co GROUP BY ALL)"
SQL["yuv_read"] = f"WITH {_PX.replace('px AS MATERIALIZED', 'pp AS MATERIALIZED')}, px AS (SELECT pp.* FROM pp JOIN (SELECT media_id, count(*) // 25 AS height FROM pp GROUP BY media_id) h ON h.media_id = pp.media_id WHERE y < height), {_CODED}, {_chroma}, al AS (SELECT media_id, 0 AS plane, y, x, luma AS value FROM co UNION ALL SELECT media_id, 1, y, x, u FROM ch UNION ALL SELECT media_id, 2, y, x, v FROM ch) SELECT media_id, plane, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, value FROM al"


# --- mosaics ---

_W, _BITS = 5, 12


def mosaics(spark: SparkSession, sf: str) -> DataFrame:
    """A raw picture of five columns for each order: a row for each line item, of 12-bit samples."""
    sample = lambda i: (F.col("l_partkey") * (i * 37 + 11) + F.col("l_suppkey") * 5) % 4096
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.transform(F.sequence(F.lit(0), F.lit(_W - 1)), lambda i: sample(i).cast("int")).alias("v"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return lines.select("media_id", F.lit(_W).alias("width"), F.size("rows").alias("height"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("raw"))


def _demosaic(phase: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r, g, b = rs.demosaic(F.col("raw"), F.col("width"), F.col("height"), _BITS, phase)
        return rs.unpack(mosaics(spark, sf).select("media_id", "width", r.alias("r"), g.alias("g"), b.alias("b")), ("r", "g", "b"))

    return run


def _demosaic_sql(phase: str) -> str:
    left, top = rs.PHASES[phase]
    ring = lambda pairs: f"(SELECT CAST(floor(avg(n.v) + CAST(0.5 AS DOUBLE)) AS DOUBLE) FROM m n WHERE n.media_id = m.media_id AND (n.x - m.x, n.y - m.y) IN ({pairs}))"
    sides, corners = ring("(-1, 0), (1, 0), (0, -1), (0, 1)"), ring("(-1, -1), (1, -1), (-1, 1), (1, 1)")
    return f"""WITH l AS (SELECT l_orderkey AS media_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS y, l_partkey AS p, l_suppkey AS q FROM lineitem),
m AS MATERIALIZED (SELECT media_id, y, x, (p * (x * 37 + 11) + q * 5) % 4096 AS v FROM l, range({_W}) t(x)),
c AS (SELECT media_id, y, x, CASE WHEN x % 2 = {left} AND y % 2 = {top} THEN v ELSE {corners} END AS r, CASE WHEN (x + y) % 2 <> {(left + top) % 2} THEN v ELSE {sides} END AS g, CASE WHEN x % 2 <> {left} AND y % 2 <> {top} THEN v ELSE {corners} END AS b FROM m)
SELECT media_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {', '.join(f"CAST(floor(coalesce({n}, 0) / CAST(4095 AS DOUBLE) * 255 + CAST(0.5 AS DOUBLE)) AS INTEGER) AS {n}" for n in 'rgb')} FROM c"""


for _phase in rs.PHASES:
    QUERIES[f"demosaic_{_phase.lower()}"] = _demosaic(_phase)
    SQL[f"demosaic_{_phase.lower()}"] = _demosaic_sql(_phase)
