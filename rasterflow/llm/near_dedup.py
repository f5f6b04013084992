"""Near-duplicate components from bottom-k sketches of one hash function.

A document's set is its distinct shingles, hashed to 64 bits; its sketch is the k smallest hashes. Documents with equal sets
are one class, and only classes go on. The retained values form inverted lists. Two sets with a Jaccard similarity of 0.75
share at least MIN_SHARED of the k smallest values of their union, so a list needs only those members for which the value
is among their k - MIN_SHARED + 1 rarest: a passage that half the corpus holds makes no list of all its documents.

The members of a short list meet each other. Those of the longer lists with the same most central member are a group, and a
group never makes all its pairs. Its core is the set of the shingles that more than half of its members hold, and each
member x is described by its differences D(x) from the core (shingles that it lacks or adds). For any core, sets x and y link
exactly if 14 |D(x) & D(y)| >= e(x) + e(y), with the excess e(x) = 7 |D(x)| - |x|: the similarity of 0.75 is a symmetric
difference of at most a seventh of the two sizes (other similarities have another ratio()). So with m the member of the least excess, every x with e(x) + e(m) <= 0
links with m whatever both hold, and all of these are one component. Any other member needs differences in common with
whatever it links with, and how many is bounded below by its own excess and e(m). So the group's open members meet again in
lists keyed by a difference, of which each has its rarest only, as few as that bound leaves. A difference is shared by at
most half of a group, so lists get shorter from level to level until all are short; no list is left out. Pairs in which too
few differences are left to reach their bound go, and so do pairs that are in one component by then. The union sketch
filters the others, and links are confirmed by the exact similarity of the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, materialize, named, rolling, scratch, spare, word_hashes

SHINGLE = 5
#: Retained values, and the least number of the union's K smallest that a pair with similarity 0.75 shares: the chance of
#: fewer is P(Binomial(64, 0.75) < 24), under 1e-11. Sets of K shingles or fewer are retained whole, without any chance.
K, MIN_SHARED = 64, 24
PERCENT = 75
#: Members of a short list of sketch values, of a short list of differences (whose pairs are nearly all ruled out by what
#: is left of their differences, before they are made), and of a part of a group.
SHORT, DEEP, PART = 16, 512, 64
#: A class with more than a share of 1 / HOT of all rows is joined by broadcast: HOT classes at most.
HOT = 10_000


def ratio(percent: int) -> int:
    """c, if a similarity of percent is a symmetric difference of at most 1 / c of the two sizes: 7 for 75, 9 for 80."""
    c, rest = divmod(100 + percent, 100 - percent)
    if rest:
        raise ValueError("(100 + percent) / (100 - percent) must be a whole number")
    return c


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles of text; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique((rolling(h, SHINGLE) if len(h) >= SHINGLE else rolling(h, len(h), 1 + len(h)) if len(h) else h).view(np.int64))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s[:K] for s in sets], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "sketch"])

    return docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key binary, sketch array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, active: DataFrame) -> DataFrame:
    """rep, set for the documents in active (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], ["rep", "set"])

    return docs.select(named(docs, id_col).cast("long").alias("rep"), named(docs, text_col).alias("text")).join(active, "rep", "left_semi").mapInArrow(run, "rep long, set array<long>")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """value, rep, size, central: the members of each list; classes: rep, size, sketch. central grows with how common a member's values are."""
    retained = classes.select("rep", "size", F.size("sketch").alias("retained"), F.explode("sketch").alias("value"))
    common = retained.groupBy("value").count().where("count > 1")
    own = Window.partitionBy("rep")
    ranked = retained.join(common, "value").withColumns({"place": F.row_number().over(own.orderBy("count", "value")), "shared": F.count(F.lit(1)).over(own), "central": F.sum("count").over(own)})
    least = F.least(F.lit(MIN_SHARED), F.ceil(F.col("retained") * PERCENT / 100))
    return ranked.where(F.col("place") - F.col("shared") <= 1 - least).select("value", "rep", "size", "central")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, comp: the smallest node that each node of edges (a, b) reaches; labels spread over edges and jump along labels.

    A label that more than 1 / HOT of the nodes carry jumps by broadcast, so its nodes don't meet in one task.
    """
    with scratch(edges.sparkSession) as keep:
        both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
        labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), label)
        often = labels.count() / HOT
        while True:
            lower = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
            near = keep(labels.join(lower, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("via")), label)
            hot = near.groupBy("via").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("via")
            to = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
            far = F.broadcast(to.join(hot, "via").withColumnRenamed("far", "hot"))  # HOT rows at most
            seen = near.join(far, "via", "left")
            rest = seen.where("hot IS NULL").join(to, "via").select("node", "old", "via", "far")
            step = keep(rest.unionByName(seen.where("hot IS NOT NULL").select("node", "old", "via", F.col("hot").alias("far"))).select("node", F.least("via", "far").alias("comp"), (F.least("via", "far") < F.col("old")).alias("moved")), label)
            labels = step.select("node", "comp")
            if not step.where("moved").limit(1).count():
                return materialize(labels, label)


def measured(pairs: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with inter, size_a, size_b of their full sets and whether they link."""
    one, two = (whole.select(F.col("rep").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    sized = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("inter"), F.size("sa").alias("size_a"), F.size("sb").alias("size_b"))
    return sized.withColumn("linked", F.col("inter") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("inter")) * percent)


def likely(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs (a, b) that the estimate from the union sketch lets pass."""
    one, two = (short.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return pairs.join(one, "a").join(two, "b").where(shared * K >= F.size(union) * MIN_SHARED).select("a", "b").distinct()


def _labelled(rows: DataFrame, comps: DataFrame, rep: str, label: str) -> DataFrame:
    return rows.join(comps.select(F.col("node").alias(rep), F.col("comp").alias(label)), rep, "left").withColumn(label, F.coalesce(label, rep))


def viable(lists: DataFrame, c: int) -> DataFrame:
    """The members of lists that some other one can reach by what is left of their differences, with n and n_open of their list before that."""
    slack = F.col("room") * (2 * c) - F.col("excess")
    own = lambda value: F.when(F.col("open"), value)
    stats = lists.groupBy("value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("open").cast("long")).alias("n_open"),
        F.min("excess").alias("low"),
        F.min(own(F.col("excess"))).alias("low_open"),
        F.max(slack).alias("high"),
        F.max(own(slack)).alias("high_open"),
    )
    both = lists.drop("n", "n_open").join(stats.where("n > 1 AND n_open > 0"), "value")
    partner = lambda name: F.when(F.col("open"), F.col(name)).otherwise(F.col(f"{name}_open"))
    return both.where((slack >= partner("low")) & (partner("high") >= F.col("excess"))).drop("low", "low_open", "high", "high_open")


def _groups(lists: DataFrame) -> DataFrame:
    """hub, rep, members, part: each group's members, dealt into parts of about PART.

    Lists with the same hub are one group if that is smaller by a quarter than the group they come from; if not, each is a group.
    """
    hubs = lists.groupBy("value").agg(F.max(F.struct("central", "rep"))["rep"].alias("hub"))
    rows = lists.join(hubs, "value").select("value", "hub", "rep", "parent")
    size = rows.select("hub", "rep", "parent").distinct().groupBy("hub").agg(F.count(F.lit(1)).alias("joint"), F.min("parent").alias("least"))
    label = F.when(F.col("joint") * 4 <= F.col("least") * 3, F.col("hub")).otherwise(F.xxhash64("value", "hub"))
    met = rows.join(size, "hub").select(label.alias("hub"), "rep").distinct()
    parts = met.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    return met.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / PART)))


def _by_part(df: DataFrame) -> DataFrame:
    """df (with hub and members) once for each part of the hub's group."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / PART) - 1))).drop("members")


def differences(members: DataFrame, counts: DataFrame, c: int) -> DataFrame:
    """members (hub, rep, members, part, set) with size, diff (how the set differs from its group's core) and excess; counts: hub, members, shingle, n."""
    cores = counts.where(F.col("n") * 2 > F.col("members")).groupBy("hub", "members").agg(F.collect_list("shingle").alias("core"))
    joined = members.join(_by_part(cores), ["hub", "part"], "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    diff = F.concat(F.array_except("set", "core"), F.array_except("core", "set"))
    size = F.size("set").cast("long")
    return joined.select("hub", "rep", "members", "part", size.alias("size"), diff.alias("diff")).withColumn("excess", F.size("diff") * c - F.col("size"))


def difference_lists(open_groups: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """value, rep, size, central, open, room, excess, parent: the members of the lists of rare differences; open_groups: differences() with least, threshold and open.

    room is how many differences a member has from this one on, in the order of rarity; parent
    is the number of the group's members.
    """
    c = ratio(percent)
    largest = F.floor(F.col("size") * 100 / percent)  # the size of the largest set that a member could link with
    partner = F.when(F.col("open"), F.col("least")).otherwise(F.col("threshold"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("excess") + partner) / (2 * c)), F.ceil((F.col("excess") - largest) / c))
    each = open_groups.withColumn("total", F.size("diff")).withColumn("prefix", F.col("total") - needed + 1).where("prefix > 0")
    each = each.select("hub", "rep", "size", "excess", "open", "total", "prefix", F.col("members").alias("parent"), F.explode("diff").alias("shingle"))
    spread = F.when(F.col("n") * 2 > F.col("members"), F.col("members") - F.col("n")).otherwise(F.col("n"))
    shared = counts.select("hub", "shingle", spread.alias("spread")).where("spread > 1")
    own = Window.partitionBy("hub", "rep")
    ranked = each.join(shared, ["hub", "shingle"]).withColumns({"place": F.row_number().over(own.orderBy("spread", "shingle")), "known": F.count(F.lit(1)).over(own), "central": F.sum("spread").over(own)})
    place = F.col("total") - F.col("known") + F.col("place")  # differences of this member alone come first
    return ranked.where(place <= F.col("prefix")).select(F.xxhash64("hub", "shingle").alias("value"), "rep", "size", "central", "open", (F.col("total") - place + 1).cast("long").alias("room"), "excess", "parent")


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of list members, one of them open at least, that sizes and what is left of their differences don't rule out."""
    left = lists.where("open").select("value", F.col("rep").alias("a"), F.col("size").alias("sa"), F.col("room").alias("ra"), F.col("excess").alias("ea"))
    right = lists.select("value", F.col("rep").alias("b"), F.col("size").alias("sb"), F.col("room").alias("rb"), F.col("excess").alias("eb"), F.col("open").alias("ob"))
    sizes = (F.col("sa") * 100 >= F.col("sb") * percent) & (F.col("sb") * 100 >= F.col("sa") * percent)
    rest = F.least("ra", "rb") * (2 * ratio(percent)) >= F.col("ea") + F.col("eb")
    once = F.when(F.col("ob"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    return left.join(right, "value").where(sizes & rest & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def all_links(lists: DataFrame, short: DataFrame | None, whole: DataFrame, percent: int = PERCENT, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect whatever all pairs of list members, and the pairs known, would; lists: value, rep, size, central. Without short (rep, sketch) no sketches filter the pairs."""
    c = ratio(percent)
    with scratch(lists.sparkSession) as keep:
        links, pairs = [], [known] if known is not None else []
        sized = keep(viable(lists.withColumns({"open": F.lit(True), "room": F.lit(1 << 40), "excess": F.lit(0).cast("long"), "parent": F.lit(1 << 40)}), c), "lists")
        short_list = SHORT
        while True:
            few = (F.col("n") <= short_list) | (F.col("n_open") * 2 <= short_list)
            pairs.append(keep(_met(sized.where(few), percent).distinct(), "met"))
            groups = keep(_groups(sized.where(~few)), "groups")
            if not groups.limit(1).count():
                break
            with scratch(lists.sparkSession) as brief:
                members = brief(groups.join(whole, "rep"), "members")
                counts = brief(members.select("hub", "members", F.explode("set").alias("shingle")).groupBy("hub", "members", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
                apart = brief(differences(members, counts, c), "apart")
                least = apart.groupBy("hub", "members").agg(F.min(F.struct("excess", "rep")).alias("m")).select("hub", "members", F.col("m.excess").alias("least"), F.col("m.rep").alias("inner"))
                placed = apart.join(_by_part(least), ["hub", "part"]).withColumn("open", F.col("excess") + F.col("least") > 0)
                links.append(keep(placed.where(~F.col("open") & (F.col("rep") != F.col("inner"))).select(F.col("inner").alias("a"), F.col("rep").alias("b")).distinct(), "sure"))
                still = placed.where("open").groupBy("hub", "members").agg(F.min("excess").alias("threshold"))
                found = brief(difference_lists(placed.join(_by_part(still), ["hub", "part"]), counts, percent), "lists")
                sized, short_list = keep(viable(brief(viable(found, c), "lists"), c), "lists"), DEEP
        sure = reduce(DataFrame.unionByName, links, pairs[0].limit(0))
        comps = components(sure)
        met = _labelled(_labelled(reduce(DataFrame.unionByName, pairs).distinct(), comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b")
        if short is not None:
            met = likely(met, short)
        return materialize(sure.unionByName(measured(met, whole, percent).where("linked").select("a", "b")), "links")


def equal_sets(found: DataFrame) -> DataFrame:
    """key, rep (the smallest id), copies: the classes of documents with equal sets; found: doc_id, n_shingles, key."""
    return found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def class_rows(found: DataFrame, firsts: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of found; links (a, b) join the classes' representatives."""
    linkable = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A class whose id several classes share is one node with them.
    shared = linkable.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id").join(linkable, "doc_id").join(firsts, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    comps = components(links.unionByName(shared))
    known = firsts.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "copies", F.coalesce("comp", "rep").alias("rep"))
    # The rows of a hot class don't meet in one task.
    least = found.count() / HOT
    hot = F.broadcast(known.where(F.col("copies") > least).select("key", F.col("rep").alias("hot")))  # HOT rows at most
    out = found.join(hot, "key", "left")
    rest = out.where("hot IS NULL").join(known.where(F.col("copies") <= least).select("key", "rep"), "key", "left")
    out = rest.unionByName(out.where("hot IS NOT NULL").withColumn("rep", F.col("hot")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (long), component_id (long), kept (boolean): one row for each row of docs.

    Words are runs outside ASCII white space, with A-Z in lower case. Documents link if 100 * intersection >= 75 * union of
    their shingle sets; component_id is the smallest id that links reach. Documents without words or with a null text
    have no shingles and are linked with nothing. Ids are cast to long, and ids that aren't numbers fail. Rows that repeat an
    id are one document: they have one component, and link with what any of them links. Rows with a null id take no part:
    component_id is null and kept is true. An empty table gives no rows; further columns are ignored. The tables between
    steps lie under spark.checkpoint.dir and are dropped at the end; the shingle sets of documents in lists are a bucketed
    table there.
    """
    with scratch(docs.sparkSession) as keep:
        found = keep(sketches(docs, id_col, text_col), "sketches")
        firsts = keep(equal_sets(found), "classes")
        linkable = found.where("doc_id IS NOT NULL AND n_shingles > 0")
        classes = linkable.select(F.col("doc_id").alias("rep"), "key", F.col("n_shingles").alias("size"), "sketch").join(firsts, ["key", "rep"]).dropDuplicates(["key", "rep"]).select("rep", "size", "sketch")
        lists = keep(inverted_lists(classes).distinct(), "lists")
        with bucketed(full_sets(docs, id_col, text_col, lists.select("rep").distinct()), "rep", "near_dedup") as whole:
            links = all_links(lists, whole.select("rep", F.slice("set", 1, K).alias("sketch")), whole)
        return materialize(class_rows(found, firsts, links), "near_dedup")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_components() doesn't keep."""
    gone = spare(docs, "gone")
    dropped = near_components(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, named(docs, id_col).cast("long") == F.col(gone), "left_anti")
