"""Queries over palettes, on images of many rows and colours, and their SQL by levels of the tree of boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import palette
from .views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WIDE, _SIZE, _LEVELS = 25, 16, 12


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """An image of 25 columns for each supplier, a pixel for each line item; every third has no more than twelve colours."""
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    p, few = F.col("l_partkey"), F.col("l_suppkey") % 3 == 0
    q = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("media_id"), F.floor(n / _WIDE).cast("int").alias("y"), (n % _WIDE).cast("int").alias("x"),
        F.when(few, p % 3 * 90).otherwise(p * 7 % 256).cast("int").alias("r"), F.when(few, p % 4 * 60).otherwise(q * 5).cast("int").alias("g"), F.when(few, 0).otherwise((F.col("l_orderkey") * 3) % 200).cast("int").alias("b"),
    )


_PICTURES = f"""px AS MATERIALIZED (SELECT l_suppkey AS media_id, n // {_WIDE} AS y, n % {_WIDE} AS x, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 3 * 90 ELSE l_partkey * 7 % 256 END AS r, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 4 * 60 ELSE q * 5 END AS g, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_orderkey * 3 % 200 END AS b
  FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS n FROM lineitem)),
c0 AS MATERIALIZED (SELECT media_id, r, g, b, '' AS path, row_number() OVER (PARTITION BY media_id ORDER BY min(y * {_WIDE} + x)) AS pos, count(*) OVER (PARTITION BY media_id) AS colours FROM px GROUP BY media_id, r, g, b)"""


def _boxes() -> str:
    """The tree of all boxes level by level, the splits that are made, and the box of each colour."""
    steps, nodes = [], []
    for k in range(_LEVELS):
        sides = "greatest(max(r) OVER w - min(r) OVER w, max(g) OVER w - min(g) OVER w, max(b) OVER w - min(b) OVER w)"
        steps.append(f"s{k} AS MATERIALIZED (SELECT *, {sides} AS side, max(r) OVER w - min(r) OVER w AS sr, max(g) OVER w - min(g) OVER w AS sg, count(*) OVER w AS n FROM c{k} WINDOW w AS (PARTITION BY media_id, path))")
        steps.append(f"o{k} AS (SELECT *, row_number() OVER (PARTITION BY media_id, path ORDER BY CASE WHEN sr = side THEN r WHEN sg = side THEN g ELSE b END, pos) AS place FROM s{k})")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT media_id, r, g, b, path || CASE WHEN place <= n // 2 THEN '0' ELSE '1' END AS path, place AS pos, colours FROM o{k} WHERE side > 0 UNION ALL SELECT media_id, r, g, b, path, pos, colours FROM o{k} WHERE side = 0)")
        nodes.append(f"SELECT DISTINCT media_id, path, side FROM s{k} WHERE side > 0 AND colours > {_SIZE}")
    tree = f"tree AS ({' UNION '.join(nodes)}), made AS MATERIALIZED (SELECT media_id, path FROM tree QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY side DESC, path) < {_SIZE})"
    full = f"full_ AS (SELECT media_id, r, g, b, path, unnest(range(0, length(path) + 1)) AS k FROM c{_LEVELS} WHERE colours > {_SIZE})"
    leaf = "leaf AS MATERIALIZED (SELECT full_.media_id, r, g, b, left(any_value(full_.path), CAST(count(made.path) AS INT)) AS path FROM full_ LEFT JOIN made ON made.media_id = full_.media_id AND made.path = left(full_.path, CAST(k AS INT)) GROUP BY full_.media_id, r, g, b)"
    mean = lambda c: f"CAST(floor(avg({c}) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS {c}"
    found = f"found AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY path) - 1 AS index, {mean('r')}, {mean('g')}, {mean('b')} FROM leaf GROUP BY media_id, path UNION ALL SELECT media_id, pos - 1, CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER) FROM c0 WHERE colours <= {_SIZE})"
    more = "pal AS MATERIALIZED (SELECT media_id, CAST(index AS INTEGER) AS index, r, g, b FROM found UNION ALL SELECT media_id, CAST(unnest(range(n, greatest(2, CAST(pow(2, ceil(log2(n))) AS BIGINT)))) AS INTEGER), 0, 0, 0 FROM (SELECT media_id, count(*) AS n FROM found GROUP BY media_id))"
    return ", ".join([_PICTURES, *steps, tree, full, leaf, found, more])


QUERIES["median_cut"] = lambda spark, sf: palette.median_cut(pictures(spark, sf), _SIZE)
SQL["median_cut"] = f"WITH {_boxes()} SELECT media_id, index, r, g, b FROM pal"
QUERIES["indexed_colours"] = lambda spark, sf: palette.indexed(pictures(spark, sf), _SIZE)
SQL["indexed_colours"] = f"""WITH {_boxes()}, d AS (SELECT c0.media_id, c0.r, c0.g, c0.b, CASE WHEN bool_or(c0.r = pal.r AND c0.g = pal.g AND c0.b = pal.b) THEN max(CASE WHEN c0.r = pal.r AND c0.g = pal.g AND c0.b = pal.b THEN index END) ELSE arg_min(index, pow(c0.r - pal.r, 2) * 1000 + pow(c0.g - pal.g, 2) * 1000 + pow(c0.b - pal.b, 2) * 1000 + index) END AS index FROM c0 JOIN pal ON pal.media_id = c0.media_id GROUP BY c0.media_id, c0.r, c0.g, c0.b)
SELECT px.media_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(index AS INTEGER) AS index FROM px JOIN d ON d.media_id = px.media_id AND d.r = px.r AND d.g = px.g AND d.b = px.b"""
