"""Exact top-k inner products by no-random-access aggregation (NRA) over sorted lists.

Candidates are dealt into blocks. In a block every dimension is a list sorted by value; a query reads it from the top where
its own component is positive and from the bottom where it is negative. All lists are read in step. After each step every
candidate has a lower bound (what was read, and the worst value of the list for the rest) and an upper bound (what was read,
and the last value read for the rest), for all queries of a block at once as matrix products. Reading stops when no outsider's
upper bound reaches the k-th best score known; survivors get their exact score. Each query first reads one block by itself;
its k-th score there is the floor from which it starts in all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named

#: Shares of each list that are read before the bounds are compared.
STEPS = (0.25, 0.5, 0.75)
#: Exact scores are made for so many survivors at a time.
CHUNK = 1 << 18
NO_FLOOR = -(2**63)


def nra(queries: np.ndarray, items: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, item rows and scores of each query's k best items and of all ties of the k-th, as far as they reach its floor.

    queries, items: integers, one row each; own[q, i] marks pairs to skip; floors: a score that k items are known to reach, or NO_FLOOR.
    The result is exact for any input; a score that doesn't fit 64 bits fails.
    """
    bound = max((np.abs(queries.astype(object)) @ np.abs(items.astype(object)).max(axis=0, initial=0)).tolist(), default=0) if len(items) else 0
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    q, x, n = queries.astype(kind), items.astype(kind), len(items)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    ranked = np.sort(x, axis=0)
    alive = ~own
    least = [None if f == NO_FLOOR else int(f) for f in (floors if floors is not None else [NO_FLOOR] * len(q))]
    for depth in [max(1, int(n * share)) for share in STEPS] if n else []:
        high, low = ranked[n - depth], ranked[depth - 1]
        upper = up @ np.maximum(x, high).T + down @ np.minimum(x, low).T
        lower = up @ np.where(x >= high, x, ranked[0]).T + down @ np.where(x <= low, x, ranked[-1]).T
        for i in range(len(q)):
            known = np.sort(lower[i][~own[i]]) if kind is object else lower[i][~own[i]]
            best = None if len(known) < k else int(known[-k] if kind is object else np.partition(known, len(known) - k)[-k])
            least[i] = max((v for v in (best, least[i]) if v is not None), default=None)
            if least[i] is not None:
                alive[i] &= upper[i] >= least[i]
        if alive.sum() <= 2 * k * len(q):
            break
    row, item = np.nonzero(alive)
    scores = [np.array([int(v) for v in (q[r] * x[i]).sum(axis=1)], dtype=np.int64) if kind is object else np.einsum("ij,ij->i", q[r], x[i]).astype(np.int64) for r, i in ((row[a : a + CHUNK], item[a : a + CHUNK]) for a in range(0, len(row), CHUNK))]
    return row, item, np.concatenate(scores) if scores else np.empty(0, dtype=np.int64)


def _best(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    order = np.lexsort((vec_id, -score, query_id))
    query_id, vec_id, score = query_id[order], vec_id[order], score[order]
    first = np.searchsorted(query_id, query_id, side="left")
    keep = np.arange(len(order)) - first < k
    return pd.DataFrame({"query_id": query_id[keep], "vec_id": vec_id[keep], "score": score[keep]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): each query's k best vectors by integer inner product.

    Components x are floor(scale * x) as double; beyond the range of a long they are its ends, and a score beyond it fails.
    Candidates are all rows of vectors but those with the query's id; ties go to the smaller id; fewer than k candidates give
    fewer rows, and candidates that repeat an id each get a rank. Rows take no part if their id or vector is null or if a
    component is null or not finite. A query meets only vectors of its own length. Queries that repeat an id count once, with
    the smallest vector. An empty side gives no rows. Ids are cast to long, and ids that aren't
    numbers fail. Further columns are ignored. Blocks of block candidates meet blocks of
    query_block queries; both sizes bound a task's memory, and each row is copied once for each block of the other side.
    """

    def clean(df: DataFrame) -> DataFrame:
        i, v = named(df, id_col), named(df, vector_col)
        whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
        return df.where(i.isNotNull() & v.isNotNull() & whole).select(i.cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"))

    items, asked = clean(vectors), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_items, n_asked = -(-max(1, items.count()) // block), -(-max(1, asked.count()) // query_block)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = items.withColumns({"cb": deal(n_items), "dim": F.size("v")})
    right = asked.withColumns({"qb": deal(n_asked), "home": F.pmod(F.xxhash64("id", F.lit("home")), F.lit(n_items)).cast("int"), "dim": F.size("v")})

    def meet(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        qid, vid = b["id"].to_numpy(), a["id"].to_numpy()
        row, item, score = nra(np.stack(b["v"]), np.stack(a["v"]), qid[:, None] == vid[None, :], k, b["floor"].to_numpy())
        return _best(qid[row], vid[item], score, k)

    def search(pairs_left: DataFrame, pairs_right: DataFrame) -> DataFrame:
        keys = ("cb", "qb", "dim")
        return pairs_left.groupBy(*keys).cogroup(pairs_right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")

    every = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    own = materialize(search(every, right.withColumn("cb", F.col("home")).withColumn("floor", F.lit(NO_FLOOR))), "own_block")
    floors = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    others = right.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1)))).where("cb <> home")
    met = own.unionByName(search(every, others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
