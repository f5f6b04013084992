"""Exact deduplication by content-defined chunk recipes.

A text without its ASCII white space is cut into chunks at punctuation, so that equal texts give equal chunks. Each distinct
chunk is stored once under an identifier, and the store is verified before any identifier is used: each stands for one chunk
text only. If one doesn't, all chunks get the next wider kind of identifier. A document is then its recipe, the ordered list
of verified identifiers, and documents are copies exactly if their recipes are equal. Only chunk texts move, once and
combined before the shuffle; long documents never move, their recipes do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize, named, text_or_empty

#: A chunk has at least MIN_CHUNK code points and ends with the first punctuation mark after that, or has MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 4096
BOUNDARY = r"[.,;:!?|。，]"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def chunks(text: Column) -> Column:
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hashed(chunk: Column) -> Column:
    """128 bits out of two unrelated hash functions."""
    low = F.shiftleft(F.hash(chunk).cast("long"), 32).bitwiseOR(F.crc32(chunk))
    return F.struct(F.xxhash64(chunk).alias("a"), low.alias("b"))


def digest(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def itself(chunk: Column) -> Column:
    return chunk


#: Kinds of identifiers, from narrow to wide; the last one can't stand for two chunks.
IDENTIFIERS = (hashed, digest, itself)


def chunk_store(texts: DataFrame, identify: Callable[[Column], Column] = hashed) -> DataFrame:
    """id, n_texts, copies: one row for each chunk identifier of texts (norm); an identifier is verified where n_texts is 1."""
    each = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    kept = each.select(identify(F.col("chunk")).alias("id"), "chunk").groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("copies"))
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("copies"))


def verified_recipes(texts: DataFrame) -> DataFrame:
    """texts (norm) with recipe in place of norm, by the first kind of identifiers of which each stands for one chunk."""
    for identify in IDENTIFIERS:
        if identify is IDENTIFIERS[-1] or chunk_store(texts, identify).where("n_texts > 1").isEmpty():
            return materialize(texts.withColumn("recipe", F.transform(chunks(F.col("norm")), identify)).drop("norm"), "recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal if they are identical without ASCII white space. Of a group the row with the most code points stays, then
    the one with the smallest id. A null text counts as empty, and all empty texts are one group, of the empty recipe. Rows
    that repeat an id and its text each get a row, with the same values. A null id comes after all others. An empty table
    gives no rows; further columns are ignored. text_sha256 is an output alone and decides nothing. The join of the recipes
    with their groups leaves a group of very many copies to Spark's splitting of skewed partitions.
    """
    text = text_or_empty(named(docs, text_col))
    texts = docs.select(named(docs, id_col).alias("doc_id"), F.length(text).alias("points"), normalised(text).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    recipes = verified_recipes(texts)
    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id")))
    groups = recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), first.alias("best")).where("group_size > 1")
    joined = recipes.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.points")))).alias("kept"),
        "text_sha256",
    )
