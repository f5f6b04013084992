"""Media-shaped views of the driver's tables: long pixels, gray rasters, layers; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each order, one pixel for each line item."""
    mod = lambda c: (F.col(c) % 256).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.lit(0).alias("y"), (F.col("l_linenumber") - 1).alias("x"), mod("l_partkey").alias("r"), mod("l_suppkey").alias("g"), (F.col("l_quantity").cast("int") * 5).alias("b"), F.lit(255).alias("a"))


PIXELS = "px AS (SELECT l_orderkey AS media_id, 0 AS y, l_linenumber - 1 AS x, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_quantity AS INTEGER) * 5 AS b, 255 AS a FROM lineitem)"


def translucent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second image for each order, with other colours and an alpha of its own, one pixel for each line item."""
    mod = lambda c, k: ((F.col(c) * k) % 256).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.lit(0).alias("y"), (F.col("l_linenumber") - 1).alias("x"), mod("l_suppkey", 7).alias("r"), mod("l_partkey", 3).alias("g"), mod("l_orderkey", 1).alias("b"), mod("l_partkey", 5).alias("a"))


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second images with holes: lines with an odd number only."""
    return translucent(spark, sf_dir).where("x % 2 = 0")


TRANSLUCENT = "tl AS (SELECT l_orderkey AS media_id, 0 AS y, l_linenumber - 1 AS x, CAST(l_suppkey * 7 % 256 AS INTEGER) AS r, CAST(l_partkey * 3 % 256 AS INTEGER) AS g, CAST(l_orderkey % 256 AS INTEGER) AS b, CAST(l_partkey * 5 % 256 AS INTEGER) AS a FROM lineitem)"
OVERLAYS = f"{TRANSLUCENT}, ov AS (SELECT * FROM tl WHERE x % 2 = 0)"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 by 8 gray raster for each embedding: media_id, width, height, v."""
    value = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255))).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", value).alias("v"))


GRID = "e AS (SELECT vec_id AS media_id, unnest(range(0, 64)) AS i, unnest(embedding) AS f FROM embeddings), g AS MATERIALIZED (SELECT media_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(least(255, greatest(0, floor((CAST(f AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS v FROM e)"
