"""Removal of repeated passages by automata of recurring phrases.

A passage repeats if WINDOW consecutive words occur more than once. Every window holds the phrase of PHRASE words whose hash
is smallest in it, and equal windows hold the same one, so only phrases that recur between different texts or in one text
can lie in a repeated window. Confirmed phrases are dealt to the blocks of documents that hold them; each block compiles its
own into an Aho-Corasick automaton over words and streams all its documents through it, which locates every occurrence.
The windows around the occurrences are counted over the whole corpus by a 128-bit hash, and what occurs more than once is
removed. Equal texts are known by their digest; one of them stands for all, so that large groups of copies cost as much as
one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, rolling, text_or_empty, word_hashes

WINDOW, PHRASE = 35, 8
#: Documents of a block, which bounds a task's texts and automaton.
BLOCK = 1024
#: Symbols of a word in an automaton; a word of no phrase is as many null characters.
DIGITS = 3

_LANES = ((0xD6E8FEB86659FD93, np.uint64(0)), (0xA0761D6478BD642F, np.uint64(0x5851F42D4C957F2D)))


def words_of(text: str | None) -> tuple[bytes, list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data, data.split()


def _window_hash(h: np.ndarray, width: int, factor: int, salt: np.uint64) -> np.ndarray:
    power, inverse = powers(factor, len(h))
    prefix = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ salt) * power, out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * inverse[: len(h) - width + 1]).view(np.int64)


def window_hashes(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every run of width words, from prefix sums of a polynomial."""
    return tuple(_window_hash(h, width, *lane) for lane in _LANES)


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The best (minimum or maximum) of every run of width values."""
    reach = 1
    while 2 * reach <= width:
        x = best(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(h: np.ndarray) -> np.ndarray:
    """Where the phrases start that have the smallest hash in some window, all of them on ties."""
    phrase = rolling(h, PHRASE)
    spread = WINDOW - PHRASE + 1
    if len(phrase) < spread:
        return np.empty(0, dtype=np.int64)
    # No window's least hash is above that of a phrase in it.
    least = np.zeros(len(phrase) + spread - 1, dtype=np.uint64)
    least[spread - 1 : len(phrase)] = _sliding(np.minimum, phrase, spread)
    return np.flatnonzero(_sliding(np.maximum, least, spread) == phrase)


def automaton(phrases: list[bytes]):
    """The words' spellings, and an Aho-Corasick automaton over them.

    A word is spelt by the DIGITS digits of its number, each place with symbols of its own, so that nodes have few edges to
    search and phrases start at words only.
    """
    import ahocorasick

    words = sorted({w for phrase in phrases for w in phrase.split(b" ")})
    base = 1
    while base**DIGITS < len(words):
        base += 1
    spelt = {w: "".join(chr(1 + place * base + i // base**place % base) for place in range(DIGITS)) for i, w in enumerate(words)}
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        found.add_word("".join([spelt[w] for w in phrase.split(b" ")]), k)
    found.make_automaton()
    return spelt, found


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, phrase, least and greatest text identity, whether one text holds it twice: combined by batch."""
    for batch in batches:
        seen: dict[tuple[int, bytes], list] = {}
        for block, text, one in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data, words = words_of(text.as_py())
            if len(words) < WINDOW:
                continue
            own = set()
            for p in anchors(word_hashes(data)).tolist():
                phrase = b" ".join(words[p : p + PHRASE])
                entry = seen.setdefault((block, phrase), [one, one, False])
                entry[0], entry[1], entry[2] = min(entry[0], one), max(entry[1], one), entry[2] or phrase in own
                own.add(phrase)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.binary()), *(pa.array([v[i] for v in seen.values()], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], ["block", "phrase", "low", "high", "twice"])


def _copies(right: pa.Table) -> dict[str, int]:
    """The digests of texts that several documents have, with the document that stands for them."""
    return {s: r for s, r in zip(right["sig"].to_pylist(), right["rep"].to_pylist(), strict=True) if s is not None}


_NO_ID = -(2**63)


def _located(left: pa.Table, right: pa.Table) -> pa.Table:
    """h1, h2, block, n: the block's windows around occurrences of its recurring phrases, counted."""
    copies, phrases = _copies(right), [p for p in right["phrase"].to_pylist() if p is not None]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if phrases and len(left):
        spelt, machine = automaton(phrases)
        other = repeat("\0" * DIGITS)
        for doc, text, sig in zip(left["doc_id"].to_pylist(), left["text"], left["sig"].to_pylist(), strict=True):
            rep = copies.get(sig)
            if rep is not None and rep != (_NO_ID if doc is None else doc):
                continue
            data, words = words_of(text.as_py())
            if len(words) < WINDOW:
                continue
            ends = [end // DIGITS for end, _ in machine.iter("".join(map(spelt.get, words, other)))]
            if not ends:
                continue
            # A phrase that ends at e lies in the windows that start at e - WINDOW + 1 to e - PHRASE + 1.
            edge = np.zeros(len(words) + 2, dtype=np.int64)
            at = np.array(ends)
            np.add.at(edge, np.maximum(at - WINDOW + 1, 0), 1)
            np.add.at(edge, at - PHRASE + 2, -1)
            starts = np.flatnonzero(edge.cumsum()[: len(words) - WINDOW + 1] > 0)
            a, b = window_hashes(word_hashes(data), WINDOW)
            found.append((a[starts], b[starts], np.full(len(starts), 1 if rep is None else 2)))
    a, b, n = (np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in range(3))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, dtype=np.int64)
    total = np.add.reduceat(n, first) if len(a) else n
    block = left["block"][0].as_py() if len(left) else 0
    return pa.table({"h1": a[first], "h2": b[first], "block": pa.array(np.full(len(first), block), pa.int32()), "n": pa.array(total, pa.int64())})


def _removed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The block's documents without the words that repeated windows cover."""
    copies = _copies(right)
    h1, h2 = (right[c].drop_null().to_numpy() for c in ("h1", "h2"))
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    runs = int(np.diff(np.flatnonzero(np.concatenate(([True], h1[1:] != h1[:-1], [True])))).max()) if len(h1) else 0
    out: list[tuple] = []
    for doc, text, sig in zip(left["doc_id"].to_pylist(), left["text"], left["sig"].to_pylist(), strict=True):
        data, words = words_of(text.as_py())
        n = len(words)
        if n < WINDOW or not (runs or sig in copies):
            kept = words
        elif sig in copies:
            kept = []
        else:
            h = word_hashes(data)
            a = _window_hash(h, WINDOW, *_LANES[0])
            at = np.searchsorted(h1, a)
            hit = h1[np.minimum(at, len(h1) - 1)] == a
            if hit.any():
                b = _window_hash(h, WINDOW, *_LANES[1])
                hit[:] = False
                for r in range(runs):
                    k = np.minimum(at + r, len(h1) - 1)
                    hit |= (h1[k] == a) & (h2[k] == b)
            kept = words
            if hit.any():
                edge = np.zeros(n + 1, dtype=np.int64)
                starts = np.flatnonzero(hit)
                edge[starts] += 1
                edge[starts + WINDOW] -= 1
                kept = [words[i] for i in np.flatnonzero(edge.cumsum()[:n] == 0).tolist()]
        joined = b" ".join(kept)
        out.append((doc, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")))
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed (long), kept_sha256, kept_text: one row for each row of docs.

    Words are runs outside ASCII white space. Each word that a repeated window covers is removed, the first occurrence as
    well; windows are judged on the input. Kept words are joined by one space. A null or empty text has no words and the
    digest of the empty string. Rows that repeat a text, with the same id or another or none, are documents of their own, so
    texts of WINDOW words or more go from all of them. Ids are cast to long, and ids that aren't numbers fail. An empty table
    gives no rows; further columns are ignored.
    """
    blocks = -(-max(1, docs.count()) // BLOCK)
    text = text_or_empty(text_col)
    sig = F.substring(F.sha2(text, 256), 1, 32)
    base = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), sig.alias("sig"))

    spread = lambda df: df.select(F.explode("blocks").alias("block"), *[c for c in df.columns if c != "blocks"])
    copies = base.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("rep"), F.collect_set("block").alias("blocks")).where("n > 1")
    copies = spread(copies.select("sig", "rep", "blocks"))
    marks = base.select("block", "text", F.xxhash64("text").alias("one")).mapInArrow(_phrases, "block int, phrase binary, low long, high long, twice boolean")
    recurring = marks.groupBy("phrase").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("twice").alias("twice"), F.collect_set("block").alias("blocks")).where("low < high OR twice")
    phrases = spread(recurring.select("phrase", "blocks"))
    by_block = base.groupBy("block")

    given = phrases.unionByName(copies, allowMissingColumns=True)
    located = by_block.cogroup(given.groupBy("block")).applyInArrow(_located, "h1 long, h2 long, block int, n long")
    repeated = spread(located.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks")).where("n > 1").select("h1", "h2", "blocks"))
    return by_block.cogroup(repeated.unionByName(copies, allowMissingColumns=True).groupBy("block")).applyInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
