"""SentencePiece encoding by a shared-prefix Viterbi search, and decoding.

Texts become marked words (runs of the space mark and what follows). The distinct words of a batch are sorted, which makes
neighbours share prefixes like the paths of a trie, and are traversed depth first: forward states of the common prefix are
kept and only those of the new characters computed; the pieces that end at a character are found by an automaton. For a unigram vocabulary the forward state of a prefix is its best
score and last piece. A byte-pair vocabulary has no additive score; there the state is the one last piece with which the
prefix's merges can end: a piece fits after another if merging both together gives just these two pieces again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import over_columns

MARK = "▁"
#: Words of a generation: with more, a task keeps them as the last one and begins another.
CACHE = 100_000


class Vocabulary:
    """Pieces and scores of a model file, and the forward search over them."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        self.kind = kind
        self.pieces = [model.id_to_piece(i) for i in size]
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in size if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.grow()
        self.penalty = min(self.scores.values(), default=0.0) - 10.0
        self.fits_after: dict[int, bool] = {}
        self.edge_parts: dict[int, tuple | None] = {}
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.split = re.compile(f"{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+|[{re.escape(alone)}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.coded = [i.to_bytes(4, "little") for i in size]
        bytes_of = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelling = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.length = np.array([len(b) for b in bytes_of], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length

    # --- the forward search ---

    def grow(self) -> None:
        """The automaton of the pieces: steps from a node by character, where to go on if there is none, and the pieces (length, number) that end at a node, longest first."""
        no_steps: dict[str, int] = {}
        self.steps, self.falls, self.ending = [{}], [0], [()]
        whole, depth, parents = [-1], [0], [(0, "")]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                if self.steps[node] is no_steps:
                    self.steps[node] = {}
                if c not in self.steps[node]:
                    self.steps[node][c] = len(whole)
                    self.steps.append(no_steps)
                    whole.append(-1)
                    depth.append(depth[node] + 1)
                    parents.append((node, c))
                node = self.steps[node][c]
            whole[node] = i
        self.falls, self.ending = [0] * len(whole), [()] * len(whole)
        for node in sorted(range(1, len(whole)), key=depth.__getitem__):
            parent, c = parents[node]
            fall, found = parent, None
            while fall and found is None:
                fall = self.falls[fall]
                found = self.steps[fall].get(c)
            self.falls[node] = fall = found or 0
            self.ending[node] = ((depth[node], whole[node]), *self.ending[fall]) if whole[node] >= 0 else self.ending[fall]

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The byte-pair merges of a short text, down to until parts: always the pair with the best score, the leftmost on ties."""
        parts = list(text)
        while len(parts) > until:
            best = max(((self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, piece: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The parts that stand at a piece's left and right end while its merges go on, each with the rank of the merge that takes it; None if merges never make the piece."""
        if piece not in self.edge_parts:
            whole, out = self.pieces[piece], ([], [])
            possible = self.merged(whole) == [whole]
            for side in (0, 1) if possible else ():
                part, rank = whole, float("inf")
                while True:
                    out[side].append((part, rank))
                    if len(part) == 1:
                        break
                    rank = -self.scores[part]
                    part = self.merged(part, 2)[side]
            self.edge_parts[piece] = out if possible else None
        return self.edge_parts[piece]

    def fits(self, before: int, piece: int) -> bool:
        """Whether the merges of both pieces together end with just these two: no merge over their border comes before those that
        take its parts. before is -1 at the start or after an unknown character.
        """
        if len(self.fits_after) > 4 * CACHE:
            self.fits_after.clear()
        right, left = self.edges(piece), self.edges(before) if before >= 0 else ([], [])
        found = right is not None and left is not None
        if found and before >= 0:
            for a, taken in left[1]:
                for b, other in right[0]:
                    score = self.scores.get(a + b)
                    if score is not None and -score < taken and -score <= other:
                        found = False
        self.fits_after[before << 32 | piece] = found
        return found

    def search(self, words: list[str]) -> Iterator[tuple[list[int], bytes]]:
        """For each of the sorted words the last piece of each prefix (-1: an unknown character), and the word's numbers.

        At each depth of the traversal stand the state (its last piece, the best score and the numbers up to there) and the
        automaton's node; a word keeps those of the prefix that it shares with the last word.
        """
        steps, falls, ending, coded, known, unigram = self.steps, self.falls, self.ending, self.coded, self.fits_after, self.kind == "unigram"
        score_of = [self.scores.get(p, 0.0) for p in self.pieces] if unigram else []
        lasts, best, nodes, numbers = [-1], [0.0], [0], [b""]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            if len(word) >= len(lasts):
                more = len(word) + 1 - len(lasts)
                lasts += [-1] * more
                best += [0.0] * more
                nodes += [0] * more
                numbers += [b""] * more
            node, at = nodes[same], same
            for c in word[same:]:
                at += 1
                found = steps[node].get(c)
                while found is None and node:
                    node = falls[node]
                    found = steps[node].get(c)
                nodes[at] = node = found or 0
                last = -1
                if unigram:
                    score = best[at - 1] + self.penalty
                    for length, piece in ending[node]:
                        total = best[at - length] + score_of[piece]
                        if last < 0 or total > score:
                            last, start, score = piece, at - length, total
                    best[at] = score
                else:
                    for length, piece in ending[node]:
                        start = at - length
                        left = lasts[start]
                        fit = known.get(left << 32 | piece)
                        if fit or fit is None and self.fits(left, piece):
                            last = piece
                            break
                lasts[at] = last
                numbers[at] = numbers[start] + coded[last] if last >= 0 else numbers[at - 1] + self._numbers([c])
            before = word
            yield lasts, numbers[at]

    def forward(self, words: list[str]) -> Iterator[list[int | str]]:
        """The pieces of each of the sorted words, by number, and unknown characters as they are."""
        for word, (lasts, _) in zip(words, self.search(words), strict=True):
            out, end = [], len(word)
            while end:
                last = lasts[end]
                out.append(last if last >= 0 else word[end - 1])
                end -= len(self.pieces[last]) if last >= 0 else 1
            yield out[::-1]

    def _numbers(self, pieces: list[int | str]) -> bytes:
        """The 32-bit numbers of pieces, as bytes; unknown characters give their UTF-8 bytes' pieces."""
        out: list[int] = []
        for p in pieces:
            if isinstance(p, int):
                out.append(p)
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
        return np.array(out, dtype="<i4").tobytes() if len(out) > 8 else b"".join(i.to_bytes(4, "little") for i in out)

    def _marks(self, n: int) -> list[int | str]:
        """A run of marks alone. Their merges have equal scores, so the left end grows first, up to the longest run there is."""
        longest = max((len(p) for p in self.ids if p == MARK * len(p)), default=1)
        whole = n // longest if self.merged(MARK * longest) == [MARK * longest] else 0
        return [self.ids.get(p, p) for p in [MARK * longest] * whole + self.merged(MARK * (n - whole * longest))]

    def learn(self, words: set[str]) -> None:
        """Adds words to the known ones."""
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = words - known.keys()
        again = new & older.keys()
        known.update([(w, older[w]) for w in again])
        new -= again
        # Of a run of marks the last may join the word, the others come after all other merges.
        runs = {w: w.lstrip(MARK) for w in new if w[:2] == MARK * 2 or w == MARK} if self.kind != "unigram" else {}
        short = sorted((new - runs.keys()) | {MARK + b for b in runs.values() if b} - known.keys())
        for w, (_, own) in zip(short, self.search(short), strict=True):
            known[w] = own
        mark = self._numbers([self.ids.get(MARK, MARK)])
        for w, b in runs.items():
            if not b:
                known[w] = self._numbers(self._marks(len(w)))
                continue
            own, spare = known[MARK + b], len(w) - len(b) - 1
            known[w] = self._numbers(self._marks(spare)) + own if not own.startswith(mark) else self._numbers(self._marks(spare + 1)) + own[len(mark) :]

    def words(self, text: str) -> list[str]:
        return self.split.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), dtype="<i4") for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary count as unknown."""
        ids = np.where((ids >= 0) & (ids < len(self.pieces)), ids, self.unknown)
        size = self.length[ids]
        if not size.sum():
            return ""
        where = np.arange(size.sum()) + np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        data = self.spelling[where].tobytes()
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str, kind: str = "bpe") -> Vocabulary:
    return Vocabulary(path, kind)


def default_model() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


#: Texts of a step are taken together up to so many characters.
STEP = 2_000_000


def _steps(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of batch of about STEP in sizes, one row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, side="right")))
        yield batch.slice(first, last - first)
        first = last


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, kind: str = "bpe", decoded_col: str | None = None) -> DataFrame:
    """docs with ids (array<int>): the pieces of each text; null for a null text, empty for an empty one.

    The text gets a leading mark, spaces become marks, and characters outside the vocabulary their UTF-8 bytes. Nothing is
    shuffled. Rows that repeat have equal ids; an empty table gives no rows; a column with the name of ids_col is replaced.
    With decoded_col the text of the ids comes as well, as decode() gives it, from the same Python process.
    """
    path = path or default_model()
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        vocab = vocabulary(path, kind)
        for batch in batches:
            for part in _steps(batch, pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)):
                texts = part.column(at).to_pylist()
                ids = [None if t is None else i for t, i in zip(texts, vocab.encode([t or "" for t in texts]), strict=True)]
                decoded = [pa.array([None if i is None else vocab.decode(i) for i in ids], pa.string())] if decoded_col else []
                yield [*part.columns, pa.array(ids, pa.list_(pa.int32())), *decoded]

    return over_columns(docs, kept, run, [(ids_col, T.ArrayType(T.IntegerType())), *([(decoded_col, "string")] if decoded_col else [])])


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of ids; null for null ids. A null id within an array counts as unknown."""
    path = path or default_model()
    kept = [c for c in df.columns if c != text_col]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in _steps(batch, pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)):
                texts = [vocab.decode(x.values.fill_null(-1).to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part.column(at)]
                yield [*part.columns, pa.array(texts, pa.string())]

    return over_columns(df, kept, run, [(text_col, "string")])
