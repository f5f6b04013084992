"""Exact Jaccard join of n-gram sets by PartEnum signatures.

Sets with a Jaccard similarity of PERCENT or more differ in at most (a + b) / c elements, with a and b their sizes and
c = (100 + PERCENT) / (100 - PERCENT). Sizes are divided into bands; a set takes part in its own band and in the one that the
largest set it can link with lies in, so any two sets that link meet in a band. Within a band the feature domain is
partitioned twice by a hash: into first-level parts, more than the pairs of a band can spoil with K2 + 1 differences in
each, and each of these into N2 second-level parts. At least one first-level part holds K2 differences at most, so there
some N2 - K2 second-level parts are the same in both sets: a signature is such a subset of parts with what the set has in it,
and subsets without elements give none. That is safe for a set with enough solid parts (more than K2 of whose second-level
parts have elements): any set that links with it shares a signature with elements. The few others enter another
partition of the domain as well, and at last each element by itself; of two sets that link, either one is solid in a
partition that both enter, or both go on. In bands of tiny sets each element is a part of its own and the subsets leave out as
many elements as two sets can differ in. No pair of any size or similarity is left to chance.

What shares a signature meets pair by pair. A profile of each set, a bit for each bucket of a hash that says whether an odd
number of its elements falls there, bounds the difference of a pair from below and rules most out: after the join in short
lists, and within the task, without making pairs, in lists of up to LONG. There are as many buckets as elements at least, so that
profiles of large sets say as much as those of small ones. The others are confirmed on full sets: pairs one by one, and longer
lists and clusters of many like profiles as groups around a core as in near_dedup.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, materialize, mix, named, scratch
from .near_dedup import SHORT, all_links, class_rows, components, equal_sets, full_sets, ratio, set_key, shingle_set

PERCENT = 80
#: Second-level parts of a first-level part, and how many of them are left out of a signature.
N2, K2 = 2, 1
#: A band's largest set over its smallest one; bands of sets up to TINY have a part for each element.
BAND, TINY = 1.5625, 10
#: Partitions of the domain that a set without enough solid parts enters before each element is a signature.
LEVELS = 3
#: Distinct sets that a task remembers, so that copies it meets give no signatures again.
SEEN = 100_000

#: Buckets of a profile, at least; a power of two.
BUCKETS = 1024
#: Members of a list whose profiles are compared within a task; a cluster with more pairs of like profiles than ALIKE a member is a group.
LONG, ALIKE = 4096, 4
#: Members of a list that are tried as the middle of its largest cluster.
TRIED = 8

_SUBSETS = np.array([[i in kept for i in range(N2)] for kept in combinations(range(N2), N2 - K2)], dtype=np.uint64)


@lru_cache(maxsize=1024)
def band_ends(size: int) -> tuple[int, ...]:
    """The largest sizes of the bands up to the one that holds size."""
    ends, start = [], 1
    while not ends or ends[-1] < size:
        ends.append(max(start, int(start * BAND)))
        start = ends[-1] + 1
    return tuple(ends)


def first_parts(end: int, percent: int = PERCENT) -> int:
    """First-level parts of the band of sets up to end: an eighth and two more than have to be there."""
    least = 2 * end // ratio(percent) // (K2 + 1) + 1
    return least + least // 8 + 2


@lru_cache(maxsize=4096)
def _salt(*numbers: int) -> np.uint64:
    out = np.uint64(0)
    for n in numbers:
        out = mix(np.array([out], dtype=np.uint64) + np.uint64(n + 1))[0]
    return out


def _tiny(s: np.ndarray, end: int, differences: int) -> np.ndarray:
    """Signatures of s without up to differences of its elements."""
    value = mix(s ^ _salt(end, 99))
    total = value.sum(dtype=np.uint64, keepdims=True)
    sums = [total - value[list(left)].sum(dtype=np.uint64) for n in range(min(differences, len(s) - 1) + 1) for left in combinations(range(len(s)), n)]
    return mix(np.concatenate(sums) ^ _salt(end, 98))


def _partitioned(s: np.ndarray, end: int, level: int, percent: int) -> tuple[np.ndarray, int]:
    """The signatures of s in one partition of the domain, and its solid parts."""
    n1 = first_parts(end, percent)
    hashed = mix(s ^ _salt(end, level))
    at = (hashed % np.uint64(n1 * N2)).astype(np.int64)
    sums = np.zeros(n1 * N2, dtype=np.uint64)
    np.add.at(sums, at, mix(hashed + np.uint64(1)))
    held = np.bincount(at, minlength=n1 * N2).reshape(n1, N2)
    solid = int(((held > 0).sum(axis=1) > K2).sum())
    value = sums.reshape(n1, N2) @ _SUBSETS.T
    number = np.arange(value.size, dtype=np.uint64).reshape(value.shape)
    full = held @ _SUBSETS.T.astype(np.int64) > 0
    return mix(value[full] ^ mix(number[full] + _salt(end, level, 7))), solid


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set of distinct 64-bit hashes; none where only an equal set can link."""
    size, c = len(s), ratio(percent)
    if not size:
        return np.empty(0, dtype=np.int64)
    s = s.view(np.uint64)
    largest = size * 100 // percent
    ends = band_ends(largest)
    out = []
    for k in range(bisect_left(ends, size), len(ends)):
        end = ends[k]
        differences = (size + min(end, largest)) // c
        if not differences:
            continue
        if end <= TINY:
            out.append(_tiny(s, end, differences))
            continue
        for level in range(LEVELS):
            found, solid = _partitioned(s, end, level, percent)
            out.append(found)
            if solid > differences // (K2 + 1):
                break
        else:
            out.append(mix(s ^ _salt(end, 97)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, dtype=np.int64)


def profile(s: np.ndarray) -> bytes:
    """A bit for each bucket, set if an odd number of elements of s falls into it; buckets: the power of two from the size of s on, BUCKETS at least."""
    n = max(BUCKETS, 1 << (len(s) - 1).bit_length())
    at = (mix(s.view(np.uint64)) & np.uint64(n - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=n) % 2 > 0, bitorder="little").tobytes()


def _words(profiles: list[bytes], size: int) -> np.ndarray:
    """Profiles as rows of 64-bit words, folded to a size in bytes: the two halves of one give that of half as many buckets."""
    out = np.empty((len(profiles), size // 8), dtype="<u8")
    length = np.array([len(p) for p in profiles], dtype=np.int64)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        rows = np.frombuffer(b"".join([profiles[i] for i in at.tolist()]), dtype="<u8").reshape(len(at), -1)
        while rows.shape[1] > out.shape[1]:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[at] = rows
    return out


def by_bits(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """So many elements at least are in one set only, by rows of profiles."""
    return np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)


def by_counts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """by_bits() for rows of numbers of elements."""
    return np.abs(one - two).sum(axis=1, dtype=np.int64)


def differing(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """by_bits() for pairs of profiles of any sizes."""
    least = np.array([min(len(a), len(b)) for a, b in zip(one, two, strict=True)], dtype=np.int64)
    out = np.zeros(len(one), dtype=np.int64)
    for n in np.unique(least).tolist():
        at = np.flatnonzero(least == n)
        out[at] = by_bits(*(_words([x[i] for i in at.tolist()], n) for x in (one, two)))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set), profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([profile(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "key", "profile"])

    return docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key binary, profile binary")


def _signed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """value, doc_id: the signatures of each set; copies within a task give them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found: list[np.ndarray] = []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                key = set_key(s)
                found.append(np.empty(0, dtype=np.int64) if key in seen else signatures(s, percent))
                if len(seen) < SEEN:
                    seen.add(key)
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, dtype=np.int64), pa.int64()), pa.array(ids, pa.int64())], ["value", "doc_id"])

    given = docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).alias("text")).where("doc_id IS NOT NULL")
    return given.mapInArrow(run, "value long, doc_id long")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted (value, doc_id) whose value the row before or after has too."""
    last: tuple[np.ndarray, np.ndarray] = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    same = False
    for batch in batches:
        if not batch.num_rows:
            continue
        value, doc = (np.concatenate((held, batch.column(i).to_numpy())) for i, held in enumerate(last))
        alike = value[1:] == value[:-1]
        kept = np.concatenate(([same], alike)) | np.concatenate((alike, [False]))
        # The last row waits for the next batch.
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][kept[:-1]], pa.int64()) for x in (value, doc)], ["value", "doc_id"])
        last, same = (value[-1:], doc[-1:]), bool(kept[-1])
    if same:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in last], ["value", "doc_id"])


def signature_lists(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """value, rep, size, central, n: what shares a signature; signed: value, doc_id; classes: doc_id, rep, size. Signatures are shuffled once, and sorted rather than gathered."""
    shared = signed.repartition("value").sortWithinPartitions("value").mapInArrow(_repeated, "value long, doc_id long")
    members = shared.join(classes, "doc_id").select("value", "rep", "size").distinct()
    sized = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("value"))).where("n > 1")
    return sized.select("value", "rep", "size", F.sum("n").over(Window.partitionBy("rep")).alias("central"), "n")


def likely_pairs(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose profiles don't differ by more than sets that link can; profiles: rep, size, profile."""
    c = ratio(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = differing(*(batch.column(f"profile_{x}").to_pylist() for x in "ab")) * c <= batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(near))

    for x in "ab":
        pairs = pairs.join(profiles.select(F.col("rep").alias(x), F.col("size").alias(f"size_{x}"), F.col("profile").alias(f"profile_{x}")), x)
    return pairs.mapInArrow(run, "a long, b long").distinct()


def clusters(size: np.ndarray, profiles: np.ndarray, percent: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] = by_counts) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of two places) of members whose profiles let them link, and the cluster of each member that is in one of many such pairs, else -1.

    The members like one that has many like it are one cluster, and not compared with each other; all others are compared with
    all. apart: by how many elements two sets differ at least.
    """
    n, c = len(size), ratio(percent)
    row = lambda v: np.maximum(apart(profiles, profiles[v]), np.abs(size - size[v])) * c <= size + size[v]
    tried = [row(v) for v in np.unique(np.linspace(0, n - 1, min(n, TRIED)).astype(np.int64))]
    core = max(tried, key=lambda r: r.sum())
    if core.sum() <= 2 * ALIKE:
        core = np.zeros(n, dtype=bool)
    parent = np.arange(n)
    if core.any():
        parent[core] = np.flatnonzero(core)[0]
    found: list[np.ndarray] = [np.empty((0, 2), dtype=np.int64)]

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for v in np.flatnonzero(~core).tolist():
        alike = row(v)
        alike[v:] &= core[v:]
        near = np.flatnonzero(alike)
        found.append(np.column_stack((near, np.full(len(near), v))))
        for u in near.tolist():
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    label = np.array([root(v) for v in range(n)], dtype=np.int64)
    pairs = np.concatenate(found)
    many = np.bincount(label[pairs[:, 0]], minlength=n) > ALIKE * np.bincount(label, minlength=n)
    if core.any():
        many[label[np.flatnonzero(core)[0]]] = True
    return pairs[~many[label[pairs[:, 0]]]], np.where(many[label], label, -1)


def compared_lists(lists: DataFrame, percent: int) -> DataFrame:
    """value, a, b: the pairs (a, b) of each list's members whose profiles let them link, and the members a of its clusters, of which each has a value; lists: value, rep, size, profile."""

    def compared(value: int, reps: np.ndarray, size: np.ndarray, given: list[bytes]) -> list[tuple]:
        profiles = _words(given, min(map(len, given)))
        pairs, cluster = clusters(size, profiles, percent, by_bits)
        apart = mix(np.uint64(value & (2**64 - 1)) ^ mix(cluster.astype(np.uint64) + np.uint64(1))).view(np.int64)
        met = np.sort(reps[pairs], axis=1).tolist()
        return [(value, *p) for p in met] + [(int(apart[v]), int(reps[v]), None) for v in np.flatnonzero(cluster >= 0).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            value, reps, size = (rows.column(i).to_numpy() for i in range(3))
            profiles = rows.column(3).to_pylist()
            starts = [*np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))).tolist(), len(value)]
            found = [f for s, e in zip(starts, starts[1:], strict=False) for f in compared(int(value[s]), reps[s:e], size[s:e], profiles[s:e])]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["value", "a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            value = rows.column(0).to_numpy()
            if not len(value):
                continue
            # The last list can go on in the next batch.
            last = int(np.searchsorted(value, value[-1]))
            if last:
                yield out(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield out(held)

    return lists.select("value", "rep", "size", "profile").repartition("value").sortWithinPartitions("value").mapInArrow(run, "value long, a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (long): one row for each row of docs.

    Words are runs outside ASCII white space, with A-Z in lower case; a set is the distinct five-word shingles, or the whole
    sequence of fewer words. Documents link if 100 * intersection >= percent * union; component_id is the smallest id that
    links reach. Documents without words or with a null text have no shingles and are linked with nothing. Ids are cast to
    long, and ids that aren't numbers fail. Rows that repeat an id are one document. Rows with a null id take no part, and
    component_id is null. An empty table gives no rows; further columns are ignored. The tables between steps lie under
    spark.checkpoint.dir and are dropped at the end. (100 + percent) / (100 - percent) must be a whole number.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        found = keep(_keyed(docs, id_col, text_col), "sets")
        firsts = keep(equal_sets(found), "classes")
        linkable = found.where("doc_id IS NOT NULL AND n_shingles > 0").withColumn("size", F.col("n_shingles")).join(firsts, "key")
        lists = keep(signature_lists(_signed(docs, id_col, text_col, percent), linkable.select("doc_id", "rep", "size").distinct()), "lists")
        few = lists.where(F.col("n") <= SHORT)
        one, two = (few.select("value", F.col("rep").alias(x), F.col("size").alias(f"s{x}")) for x in "ab")
        met = one.join(two, "value").where(f"a < b AND sa * 100 >= sb * {percent} AND sb * 100 >= sa * {percent}").select("a", "b").distinct()
        profiles = linkable.where("doc_id = rep").select("rep", "size", "profile").distinct()
        middle = lists.where((F.col("n") > SHORT) & (F.col("n") <= LONG)).join(profiles.select("rep", "profile"), "rep")
        compared = keep(compared_lists(middle, percent), "compared")
        # Lists compare profiles of the size of their shortest one, so their pairs are looked at again.
        pairs = keep(likely_pairs(met.unionByName(compared.where("b IS NOT NULL").select("a", "b")).distinct(), profiles, percent), "pairs")
        # Clusters of different lists that share members are one group, so no set is in two.
        alike = compared.where("b IS NULL").select("value", F.col("a").alias("rep"))
        first = alike.groupBy("value").agg(F.min("rep").alias("a"))
        joined = components(alike.join(first, "value").select("a", F.col("rep").alias("b")).distinct(), "clusters").select(F.col("comp").alias("value"), F.col("node").alias("rep"))
        alike = joined.join(lists.select("rep", "size", "central").distinct(), "rep").select("value", "rep", "size", "central")
        many = lists.where(F.col("n") > LONG).drop("n").unionByName(alike)
        active = many.select("rep").unionByName(pairs.select(F.col("a").alias("rep"))).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        with bucketed(full_sets(docs, id_col, text_col, active), "rep", "jaccard_join") as whole:
            links = keep(all_links(many, None, whole, percent, pairs), "links")
        return materialize(class_rows(found, firsts, links).drop("kept"), "jaccard_join")
