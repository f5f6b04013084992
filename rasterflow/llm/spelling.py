"""Spelling variants grouped under their most frequent form, by automata of word halves.

One edit leaves one half of a word as it is: the first half still begins the other word, or the second half still ends it.
The halves of all words are dealt into shards, and each shard compiles its own into an Aho-Corasick automaton. Every word is
scanned in the shards that can hold the beginnings and ends of it; a half that is found counts if it lies at the start or
the end, where its word has it, and if the lengths differ by one at most. What is left of the two words, beside that half,
is compared by the strings that one deletion gives (two strings one edit apart have exactly one such string in common, a
string itself included), and the distance is verified on the words. So no two words of a list meet unless they are near.
A half that more than HOT words have is dealt by those strings as well, so that no shard holds all of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, named

#: Least code points and occurrences of a word, and how many times as frequent a form is.
LENGTH, OCCURRENCES, FACTOR = 6, 5, 5
#: A run is cut by one code point where this number divides its checksum.
DIVISOR = 199
#: Halves dealt to a shard, and words of one half from which on it is dealt by what is left of them too.
SHARD, HOT = 20_000, 10_000
#: Distinct runs that a task counts before it hands them on.
HELD = 400_000

#: Runs of a-z and U+00C0 to U+00FF in UTF-8.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def cut_run(run: bytes, checksum: int) -> bytes:
    """run (in UTF-8) as it counts: without code point checksum % length if DIVISOR divides the checksum."""
    if checksum % DIVISOR:
        return run
    text = run.decode()
    at = checksum % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: combined within the task."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        kept = [(w, n) for w, n in ((k.decode(), n) for k, n in held.items()) if len(w) >= LENGTH]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            own = Counter(RUN.findall(text.as_buffer().to_pybytes().lower()))
            begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run in [r for r in own if zlib.crc32(r, begun) % DIVISOR == 0]:
                n = own.pop(run)
                held[cut_run(run, zlib.crc32(run, begun))] += n
            held.update(own)
            if len(held) > HELD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of LENGTH code points or more with their occurrences, OCCURRENCES at least."""
    runs = docs.select(named(docs, id_col).cast("string").alias("doc_id"), named(docs, text_col).cast("string").alias("text")).mapInArrow(_counted, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _beginning(size: Column) -> Column:
    """head, half, rest of word if its first size code points are the half."""
    return F.struct(F.lit(True).alias("head"), F.substring("word", F.lit(1), size).alias("half"), F.substring("word", size + 1, F.length("word")).alias("rest"))


def _end(size: Column) -> Column:
    """head, half, rest of word if its last size code points are the half."""
    start = F.length("word") - size
    return F.struct(F.lit(False).alias("head"), F.substring("word", start + 1, size).alias("half"), F.substring("word", F.lit(1), start).alias("rest"))


def _first_size(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def halves(words: DataFrame) -> DataFrame:
    """word, n, head, half, rest: both halves of each word."""
    length = F.length("word")
    return words.select("word", "n", F.inline(F.array(_beginning(_first_size(length)), _end(length - _first_size(length)))))


def reached(words: DataFrame) -> DataFrame:
    """word, n, head, half, rest: each beginning and end of a word that a half of a near word can be."""
    length = F.length("word")
    others = [length + d for d in (-1, 0, 1)]
    parts = [_beginning(_first_size(o)) for o in others] + [_end(o - _first_size(o)) for o in others]
    return words.select("word", "n", F.inline(F.array_distinct(F.array(*parts))))


def shortened(text: Column) -> Column:
    """The distinct strings that text and one deletion in it give."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), without))


def dealt(parts: DataFrame, hot: DataFrame, shards: int) -> DataFrame:
    """parts (with head and half) with shard and, where the half is a hot one, trimmed: once for each string that one deletion gives."""
    flagged = parts.join(hot, ["head", "half"], "left").withColumn("trimmed", F.explode(F.when(F.col("is_hot"), shortened(F.col("rest"))).otherwise(F.array(F.lit(None).cast("string")))))
    return flagged.drop("is_hot").withColumn("shard", F.pmod(F.xxhash64("head", "half", "trimmed"), F.lit(shards)).cast("int"))


def one_deletion(text: str) -> set[str]:
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) != 1:
        return False
    at = next((i for i, c in enumerate(short) if c != long[i]), len(short))
    return short[at:] == long[at + 1 :]


def _scanned(left: pa.Table, right: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: for each scanned word (right) its near words among those whose halves (left) the shard holds."""
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    by_rest: dict[tuple[bool, str, str], list[tuple[str, int]]] = defaultdict(list)
    for word, n, head, half, rest, trimmed in zip(*(left[c].to_pylist() for c in ("word", "n", "head", "half", "rest", "trimmed")), strict=True):
        machine.add_word(half, half)
        for t in one_deletion(rest) if trimmed is None else (trimmed,):
            by_rest[head, half, t].append((word, n))
    out: list[tuple[str, int, int, str]] = []
    if by_rest:
        machine.make_automaton()
        for word in right["scanned"].to_pylist():
            near: list[tuple[int, str]] = []
            for end, half in machine.iter(word):
                start = end + 1 - len(half)
                if start and end + 1 < len(word):
                    continue
                head = not start
                for t in one_deletion(word[len(half) :] if head else word[:start]):
                    for other, n in by_rest.get((head, half, t), ()):
                        # A word that both halves find counts where the first one finds it.
                        if one_edit(other, word) and (head or not word.startswith(other[: len(other) // 2])):
                            near.append((-n, other))
            if near:
                least = min(near)
                out.append((word, len(near), -least[0], least[1]))
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, n_near, best_n, best (the near word of largest n, then smallest): one row for each of words (word, n) that has near ones."""
    shards = -(-max(1, 2 * words.count()) // shard)
    held = halves(words)
    often = materialize(held.groupBy("head", "half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("head", "half", F.lit(True).alias("is_hot")), "hot_halves")
    left = dealt(held, often, shards)
    right = dealt(reached(words), often, shards).select(F.col("shard").alias("to"), F.col("word").alias("scanned")).distinct()
    found = left.groupBy("shard").cogroup(right.groupBy("to")).applyInArrow(_scanned, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from word in forms (word, form); every step joins pointers twice as long."""
    last = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = materialize(last.join(last.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        last = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return last


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long): one row for each word.

    Runs of A-Z, a-z and U+00C0 to U+00FF are lower-cased (A-Z only), and cut by one code point where DIVISOR divides the
    checksum of id and run; a null id counts as an empty one. Words are what has LENGTH code points and OCCURRENCES
    occurrences in all rows, repeated rows included. Two words are near if one edit apart. form is the near word of largest
    n, the smallest in code-point order on ties, if it has FACTOR times the word's n, else null; root follows forms to the
    last and is the word itself without one. Null and empty texts have no words, an empty table gives no rows, and further
    columns are ignored. Tables between steps lie under spark.checkpoint.dir.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    known = materialize(words.join(near_words(words), "word", "left"), "near_words")
    has = F.col("best_n") >= F.col("n") * FACTOR
    formed = known.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"))
    out = formed.join(roots(formed.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
