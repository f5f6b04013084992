"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines are hashed to 128 bits; windows that occur more than once in the whole corpus are found by a
combined count, the first occurrence by (document, line) stays, and the lines that later occurrences cover are merged to
intervals and cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, spare

WIDTH = 3


def line_windows(lines: Column) -> Column:
    """An array of (pos, a, b): each window's first line, from 0, and its two hashes."""
    a, b = F.transform(lines, lambda x: F.xxhash64(x)), F.transform(lines, lambda x: F.shiftleft(F.hash(x).cast("long"), 32).bitwiseOR(F.crc32(x)))
    starts = F.when(F.size(lines) >= WIDTH, F.sequence(F.lit(0), F.size(lines) - WIDTH)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.arrays_zip(starts.alias("pos"), *[F.slice(h, i + 1, F.greatest(F.size(lines) - WIDTH + 1, F.lit(0))).alias(f"{n}{i}") for n, h in (("a", a), ("b", b)) for i in range(WIDTH)]), lambda w: F.struct(w["pos"].alias("pos"), *[F.xxhash64(*[w[f"{n}{i}"] for i in range(WIDTH)]).alias(n) for n in "ab"]))


def kept_lines(lines: Column, cuts: Column) -> Column:
    """The lines outside the sorted disjoint intervals cuts of (first, last)."""
    lasts = F.concat(F.array(F.lit(-1)), F.transform(cuts, lambda c: c["last"]))
    firsts = F.concat(F.transform(cuts, lambda c: c["first"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(lasts, firsts, lambda last, first: F.slice(lines, last + 2, first - last - 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text without its repeated windows, and with n_lines and n_removed (long).

    Lines end at \\n. A window is WIDTH consecutive lines of one document; documents with fewer lines have none and stay as
    they are. Of equal windows the first by (id, line) stays; every line that another one covers is removed. Windows are
    judged on the input, not on what is left. Repeated rows of one id and text count as one document: neither removes the
    other. Rows with a null id or text take no part and stay unchanged, with n_removed 0 (n_lines 0 for a null text). A text
    of which all lines go becomes empty. Other columns pass through, whatever their names.
    """
    key, tid, lines, cuts = (spare(docs, x) for x in ("key", "tid", "lines", "cuts"))
    whole, ids = named(docs, text_col), named(docs, id_col)
    own = docs.select(ids.alias("key"), F.xxhash64(whole).alias("tid"), F.split(whole, "\n").alias("lines")).where("key IS NOT NULL AND lines IS NOT NULL")
    each = own.select("key", "tid", F.explode(line_windows(F.col("lines"))).alias("w")).select("key", "tid", "w.pos", "w.a", "w.b")
    first = each.groupBy("a", "b").agg(F.min(F.struct("key", "tid", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first")
    later = each.join(first, ["a", "b"]).where(F.struct("key", "tid", "pos") != F.col("first")).select("key", "tid", "pos").distinct()
    order = Window.partitionBy("key", "tid").orderBy("pos")
    opens = later.withColumn("new", F.coalesce((F.col("pos") > F.lag("pos").over(order) + WIDTH).cast("int"), F.lit(1)))
    island = opens.withColumn("island", F.sum("new").over(order)).groupBy("key", "tid", "island").agg(F.min("pos").alias("first"), (F.max("pos") + WIDTH - 1).alias("last"))
    cut = island.groupBy("key", "tid").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(cuts)).select(F.col("key").alias(key), F.col("tid").alias(tid), cuts)
    left = docs.withColumn(lines, F.split(whole, "\n")).join(cut, (ids == F.col(key)) & (F.xxhash64(whole) == F.col(tid)), "left")
    removed = F.coalesce(F.aggregate(cuts, F.lit(0), lambda s, c: s + c["last"] - c["first"] + 1), F.lit(0)).cast("long")
    text = F.when(F.col(cuts).isNull(), whole).otherwise(F.array_join(kept_lines(F.col(lines), F.col(cuts)), "\n"))
    out = [text.alias(c) if c == text_col else named(docs, c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return left.select(*out, F.coalesce(F.when(F.col(lines).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_removed"))
