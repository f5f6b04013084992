"""Packing tokenised documents into sequences: best fit, then swap-based local search.

Pieces are dealt into shards; each shard packs its pieces by best fit in decreasing order and then improves the underfull
bins by moving a piece, exchanging one for one or two for one, always raising the sum of squared fills, until bins empty or
no exchange helps. Bins that stay underfull meet those of neighbouring shards in a second round.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Documents dealt to a shard; shards whose underfull bins meet in the second round.
SHARD, FAN = 4096, 64
#: A bin filled less than this share is underfull after the first round.
UNDERFULL = 0.97


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, special: str, special_id: int):
    """The byte-level BPE vocabulary in path (ranks by base64 piece), with one special token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: special_id})


def tokenizer_params() -> dict:
    """The public 50k vocabulary: the same ids as byte_bpe_50k.json gives, from the file of its ranks."""
    import public_tokenizers as public

    return {"path": public.path("byte_bpe_50k.tiktoken"), "json": public.path("byte_bpe_50k.json"), "pattern": public.PATTERN, "special": "<|endoftext|>", "special_id": 50256}


@lru_cache(maxsize=4)
def slow_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, params: dict) -> np.ndarray:
    """The ids of text. Runs of white space too long for the fast encoder's regex stack go to the library that has none."""
    coder = encoder(params["path"], params["pattern"], params["special"], params["special_id"])
    try:
        return np.asarray(coder.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
    except ValueError:
        return np.asarray(slow_encoder(params["json"]).encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have capacity tokens."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: pieces in decreasing order, each into the fullest bin that has room."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, target = capacity, []
            bins.append(target)
        target.append(i)
        if room > size:
            by_room[room - size].append(target)
            open_rooms |= 1 << (room - size)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, width: int = 64) -> list[list[int]]:
    """Local search from the emptiest bin on, against the width other emptiest bins; ends at the lower bound or a local optimum.

    Taking d tokens net from bin A to bin B raises the squared fill if fill(B) + d > fill(A).
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    live = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
    count = len(bins)
    stuck: set[int] = set()

    def exchange(a: int, b: int) -> bool:
        """The best single change that takes tokens from bin a to bin b."""
        room, need = capacity - fill[b], fill[a] - fill[b]
        own, other = sorted((size[i], i) for i in bins[a]), sorted((size[i], i) for i in bins[b])
        best = (max(0, need), None, None)
        give = [(s, (i,)) for s, i in own] + [(own[x][0] + own[y][0], (own[x][1], own[y][1])) for x in range(len(own)) for y in range(x)]
        back = [(0, ()), *[(s, (i,)) for s, i in other]]
        pairs = [(other[x][0] + other[y][0], (other[x][1], other[y][1])) for x in range(len(other)) for y in range(x)]
        for options, wanted in ((sorted(back), give), (sorted(pairs), [g for g in give if len(g[1]) == 1])):
            keys = [o[0] for o in options]
            for s, ids in wanted:
                at = bisect.bisect_left(keys, s - room)
                if at < len(keys) and s - keys[at] > best[0]:
                    best = (s - keys[at], ids, options[at][1])
        if best[1] is None:
            return False
        moved, ids, returned = best
        bins[a] = [i for i in bins[a] if i not in ids] + list(returned)
        bins[b] = [i for i in bins[b] if i not in returned] + list(ids)
        fill[a], fill[b] = fill[a] - moved, fill[b] + moved
        return True

    while count > least:
        a = min((k for k in live if bins[k] and k not in stuck), key=lambda k: fill[k], default=None)
        if a is None:
            break
        others = sorted((k for k in live if k != a and bins[k] and fill[k] < capacity), key=lambda k: -fill[k])[-width:]
        if not any(exchange(a, b) for b in others):
            stuck.add(a)
        elif not bins[a]:
            count -= 1
            stuck.clear()
    return [b for b in bins if b]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and its fill, for each piece."""
    bin_of, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
    for k, members in enumerate(improve(best_fit(sizes, capacity), sizes, capacity)):
        own = sizes[members]
        bin_of[members], offset[members], fill[members] = k, np.cumsum(own) - own, own.sum()
    return bin_of, offset, fill


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, params: dict | None = None) -> DataFrame:
    """One row for each piece of each document; nothing is shuffled, and texts don't leave their task."""
    params = params or tokenizer_params()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", params), np.uint32(end_id)).astype("<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, params: dict | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece, packed into sequences of capacity.

    A document is its ids and then end_id; a null or empty text is end_id alone. Only documents over capacity are cut, into
    pieces of capacity tokens of which the first can be shorter. Repeated rows and null ids are documents of their own; ids are
    cast to long, and ids that aren't numbers fail. An empty table gives no rows; further columns are ignored.
    """
    shards = -(-max(1, docs.count()) // SHARD)

    def place(pdf: pd.DataFrame, base: int) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        bins, offset, fill = pack(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(base << 32) + bins, offset=offset, open=fill < UNDERFULL * capacity)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return place(pdf, int(pdf["shard"].iloc[0]))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["open"].iloc[0]:
            pdf = place(pdf, shards + int(pdf["shard"].iloc[0]) // FAN)
        return pdf.drop(columns=["shard", "open", "meet"])

    columns = f"{PIECES}, sequence_id long, offset long"
    dealt = pieces(docs, id_col, text_col, capacity, end_id, params).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(first, f"{PIECES}, shard int, sequence_id long, offset long, open boolean")
    meet = F.when(F.col("open"), -1 - F.floor(F.col("shard") / FAN)).otherwise(F.col("shard").cast("long"))
    return packed.withColumn("meet", meet).groupBy("meet").applyInPandas(second, columns)
