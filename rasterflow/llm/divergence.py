"""How far the sources of a language diverge in their terms: dense tiles of groups by terms.

Tasks count terms by language, source and term; terms in DOCUMENTS or more documents of a language are kept. The kept terms
of a language are dealt into blocks of about BLOCK, its sources into strips of about STRIP. A tile is a block of terms by two
strips of sources: an int64 matrix of counts, and of the shares that follow from them with the totals of the whole corpus.
Broadcasting compares all pairs of its sources at once. The pair matrices of the blocks are summed, and the bounded heaps of
each group's most divergent terms are merged. Terms of a block that neither strip holds have the same share in each and
are counted, not stored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named, text_or_empty

#: Least documents of a kept term; ranks of terms that are returned.
DOCUMENTS, RANKS = 3, 200
#: Shares are counted in units of 1 / UNIT, made in steps that int64 holds.
UNIT, STEP, STEPS = 1_000_000_000, 1000, 3
#: Terms of a tile, sources of a strip, and counts that a task holds before it hands them on.
BLOCK, STRIP, HELD = 8192, 128, 300_000

#: Runs of letters and of what lies outside ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), d (documents), combined within the task; each group has a row without a term too."""
    held: defaultdict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            size = len(n) + 1
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "d"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = Counter(TERM.findall(text.as_buffer().to_pybytes().lower()))
            n, d = held[lang, source]
            size -= len(n)
            n.update(own)
            d.update(own.keys())
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + terms)), by long division: exact while total + terms is below 2 ** 63 / STEP."""
    rest, by = np.broadcast_arrays(np.asarray(count, dtype=np.int64) + 1, np.asarray(total, dtype=np.int64) + terms)
    out = np.zeros(rest.shape, dtype=np.int64)
    for _ in range(STEPS):
        rest = rest * STEP
        out = out * STEP + rest // by
        rest = rest % by
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """lang, source, part, item, value of one tile; left: counts of its terms, right: its sources with totals."""
    lang, terms, in_block, of_lang = (right[c][0].as_py() for c in ("lang", "terms", "in_block", "of_lang"))
    sources, strip, total = right["source"].to_pylist(), right["strip"].to_numpy(), right["total"].to_numpy()
    out: list[tuple[str, str, str, int]] = []
    row = {s: i for i, s in enumerate(sources)}
    found = sorted(set(left["term"].to_pylist()), key=str.encode)
    column = {t: i for i, t in enumerate(found)}
    count = np.zeros((len(sources), len(found)), dtype=np.int64)
    everywhere = np.zeros(len(found), dtype=np.int64)
    at = np.array([column[t] for t in left["term"].to_pylist()], dtype=np.int64)
    count[np.array([row[s] for s in left["source"].to_pylist()], dtype=np.int64), at] = left["n"].to_numpy()
    everywhere[at] = left["everywhere"].to_numpy()
    diagonal = right["first"][0].as_py() == right["second"][0].as_py()
    value = np.zeros((len(sources), len(sources)), dtype=np.int64)
    if terms:
        share, unseen = shares(count, total[:, None], terms), shares(np.zeros_like(total), total, terms)
        for i in range(len(sources)):
            value[i] = gap(share[i], share).sum(axis=1) + (in_block - len(found)) * gap(unseen[i], unseen)
        if diagonal:
            usual = shares(everywhere, of_lang, terms)
            for i, source in enumerate(sources):
                own = np.flatnonzero((count[i] > 0) & (share[i] > usual))
                score = gap(share[i][own], usual[own])
                # found is in the order of ties
                out += [(source, "term", found[own[k]], -v) for v, k in heapq.nsmallest(RANKS, zip((-score).tolist(), range(len(own)), strict=True))]
    for i, source in enumerate(sources):
        out += [(source, "pair", sources[k], v) for k, v in enumerate(value[i].tolist()) if k != i and (diagonal or strip[k] != strip[i])]
    return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64())))], names=["lang", "source", "part", "item", "value"])


def _by_tile(rows: DataFrame) -> DataFrame:
    """rows (with strip and strips) once for each pair of strips that theirs is one of."""
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    return each.withColumns({"first": F.least("strip", "other"), "second": F.greatest("strip", "other")}).drop("other", "strips")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """lang, source, part, item (string), value (long), rank (int).

    Part pair has, for each source of a language, each other one with the divergence summed over all kept terms; part term its
    terms whose share is above the language's, RANKS of them at most. Terms are runs of A-Z, a-z and what lies outside
    ASCII, with A-Z in lower case; each row is a document, repeated rows too, and a term is kept in DOCUMENTS documents of
    the language. Ranks count from 1 by value, the greatest first, then by item. Null text, lang and source count as empty;
    a group without terms has pairs all the same, of value 0 if its language keeps no term. A language of one source has no
    pairs. An empty table gives no rows; further columns are ignored. Tables between steps lie under spark.checkpoint.dir.
    """
    given = docs.select(*[text_or_empty(named(docs, c).cast("string")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = given.mapInArrow(_counted, "lang string, source string, term string, n long, d long").repartition("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    alike = Window.partitionBy("lang", "term")
    known = summed.withColumns({"everywhere": F.sum("n").over(alike), "in_docs": F.sum("d").over(alike), "lead": (F.row_number().over(alike.orderBy("source")) == 1).cast("long")})
    kept = materialize(known.where(F.col("term").isNull() | (F.col("in_docs") >= DOCUMENTS)).select("lang", "source", "term", "n", "everywhere", "lead"), "terms")

    some = F.col("term").isNotNull()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(some, F.col("lead")).otherwise(0)).alias("leads"))
    totals = materialize(totals, "totals")
    langs = totals.groupBy("lang").agg(F.sum("leads").alias("terms"), F.sum("total").alias("of_lang"), F.count(F.lit(1)).alias("sources"))
    langs = langs.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int"), "strips": F.ceil(F.col("sources") / strip).cast("int")})
    langs = materialize(langs, "languages")
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    placed = kept.where(some).join(langs.select("lang", "blocks", "strips"), "lang").select("lang", "source", "term", "n", "everywhere", "lead", "strips", of("term", "blocks").alias("block"), of("source", "strips").alias("strip"))
    in_block = materialize(placed.groupBy("lang", "block").agg(F.sum("lead").alias("in_block")), "blocks")
    cells = _by_tile(placed.drop("lead"))
    heads = totals.join(langs, "lang").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "strip": of("source", "strips")})
    heads = _by_tile(heads.join(in_block, ["lang", "block"], "left").fillna(0, ["in_block"]))
    keys = ["lang", "block", "first", "second"]
    tiles = materialize(cells.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(_tile, "lang string, source string, part string, item string, value long"), "tiles")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    return ranked(pairs).unionByName(ranked(tiles.where("part = 'term'")).where(F.col("rank") <= RANKS))
