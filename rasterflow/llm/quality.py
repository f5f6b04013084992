"""Quality classifier by co-training of two views.

The content view sees the text (classes of byte pairs, hashed words), the metadata view sees language, source and length.
Both start from the labelled sample; in each round either view scores all unlabelled documents and labels the ones of which
it is most confident for the other one. Each view is calibrated on held-out labels, a small model combines the calibrated
views, and the combination scores every document where it lies. Features of the unlabelled documents are computed once and
written; a round is one pass over them that keeps the best of each batch, so the driver gets PER_ROUND rows a view at most.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, over_columns, word_hashes

#: Bound of the labelled documents that training sees. Pseudo-labels come from all others, and scoring sees everything.
LABELLED = 6000
#: Rounds, pseudo-labels that a view gives in each, and the confidence that they need.
ROUNDS, PER_ROUND, CONFIDENT = 4, 300, 0.95
WORD_BINS, META_BINS, REPEATS = 128, 64, 5

# Byte classes: control, space, digit, lower, upper, sentence punctuation, other punctuation, beyond ASCII.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[:32], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:'-"]] = 5


def content_features(text: str | None) -> np.ndarray:
    """Shares of pairs of byte classes, of hashed words, and of repetition; short texts are shrunk towards none of either."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(64 + WORD_BINS + REPEATS, dtype=np.float32)
    if len(data) > 1:
        kind = _CLASS[np.frombuffer(data, dtype=np.uint8)]
        out[:64] = np.sqrt(np.bincount(kind[:-1] * 8 + kind[1:], minlength=64) / (len(kind) + 100))
    words = word_hashes(data)
    if len(words):
        n = len(words) + 16
        out[64 : 64 + WORD_BINS] = np.sqrt(np.bincount((words % np.uint64(WORD_BINS)).astype(np.int64), minlength=WORD_BINS) / n)
        most = np.unique(words, return_counts=True)[1]
        again = np.count_nonzero(words[1:] == words[:-1]) / n
        out[64 + WORD_BINS :] = again, np.sqrt(again), most.max() / n, (len(words) - len(most)) / n, min(1.0, len(words) / 50)
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_BINS + 16, dtype=np.float32)
    for name, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{name}={value}".encode()) % META_BINS] += 1
    out[META_BINS + (0 if n_chars is None or n_chars < 1 else min(15, 1 + int(math.log2(n_chars))))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class Model:
    """Weights of the views, their calibrations (slope, constant), and of the combination; base is used where nothing was learnt."""

    content: np.ndarray | None
    meta: np.ndarray | None
    calibrations: tuple[np.ndarray, np.ndarray] | None
    combined: np.ndarray | None
    base: float

    def views(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([logit(logit(x, w)[:, None], c) for x, w, c in ((content, self.content, self.calibrations[0]), (meta, self.meta, self.calibrations[1]))], axis=1)

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of good quality by content, by metadata, and by both."""
        if self.combined is None:
            return (np.full(len(content), self.base),) * 3
        v = self.views(content, meta)
        return tuple(1 / (1 + np.exp(-z)) for z in (v[:, 0], v[:, 1], logit(v, self.combined)))


#: One view's weights and calibration.
Fit = tuple[np.ndarray, np.ndarray]
#: A pseudo-label: the view that gives it, the label, its confidence, doc_id, and the document's features.
Picked = tuple[int, int, float, int, np.ndarray, np.ndarray]


def confident(fits: list[Fit], shares: tuple[int, int], taken: set[int], ids: np.ndarray, features: tuple[np.ndarray, np.ndarray]) -> list[Picked]:
    """For each view and label the shares[label] documents of which it is most confident, by confidence and then id."""
    out = []
    free = np.array([i not in taken for i in ids.tolist()], dtype=bool)
    for v, (w, c) in enumerate(fits):
        p = 1 / (1 + np.exp(-logit(logit(features[v], w)[:, None], c)))
        for label, sure in ((1, p), (0, 1 - p)):
            rows = np.flatnonzero(free & (sure >= CONFIDENT))
            for i in rows[np.lexsort((ids[rows], -sure[rows]))][: shares[label]].tolist():
                out.append((v, label, float(sure[i]), int(ids[i]), features[0][i], features[1][i]))
    return out


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, pick: Callable[[list[Fit], tuple[int, int], set[int]], list[Picked]]) -> Model:
    """held marks the labelled rows that only calibrate; pick is confident() over all unlabelled documents.

    A document can be picked by both views in one round, and in later rounds not again.
    """
    base = float(y.mean()) if len(y) else 1.0
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        return Model(None, None, None, None, base)
    own = (content, meta)
    extra: list[list[Picked]] = [[], []]
    taken: set[int] = set()
    shares = (max(1, round(PER_ROUND * (1 - base))), max(1, round(PER_ROUND * base)))

    def fit(v: int) -> Fit:
        x = np.vstack([own[v][~held], *(e[4 + v][None, :] for e in extra[v])])
        w = logistic(x, np.concatenate([y[~held], [float(e[1]) for e in extra[v]]]))
        return w, logistic(logit(own[v][held], w)[:, None], y[held], ridge=1e-2)

    for _ in range(ROUNDS):
        picked = pick([fit(0), fit(1)], shares, taken)
        for e in picked:
            extra[1 - e[0]].append(e)
        taken |= {e[3] for e in picked}
    (wc, cc), (wm, cm) = fit(0), fit(1)
    model = Model(wc, wm, (cc, cm), None, base)
    model.combined = logistic(model.views(content[held], meta[held]), y[held], ridge=1e-1)
    return model


SIZES = (64 + WORD_BINS + REPEATS, META_BINS + 16)


def _read(column, size: int) -> np.ndarray:
    rows = [np.frombuffer(x, dtype=np.float32) for x in column]
    return np.stack(rows) if rows else np.zeros((0, size), dtype=np.float32)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, quality, content, meta: the features of docs (with quality) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = ([content_features(r["text"]).tobytes() for r in rows], [meta_features(r["lang"], r["source"], r["n_chars"]).tobytes() for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(m, pa.binary()) for m in made)], ["doc_id", "quality", "content", "meta"])

    return docs.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(run, "doc_id long, quality int, content binary, meta binary")


def picker(unlabelled: DataFrame) -> Callable[[list[Fit], tuple[int, int], set[int]], list[Picked]]:
    """confident() over all rows of unlabelled (as for featured()): the best of each batch, then the best of all. Features are made at the first call."""
    stored: list[DataFrame] = []

    def pick(fits: list[Fit], shares: tuple[int, int], taken: set[int]) -> list[Picked]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                best = confident(fits, shares, taken, ids, tuple(_read(batch.column(1 + v).to_pylist(), SIZES[v]) for v in (0, 1)))
                columns = [pa.array([e[i] for e in best], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([e[i].tobytes() for e in best], pa.binary()) for i in (4, 5))], ["view", "label", "sure", "doc_id", "content", "meta"])

        if not stored:
            stored.append(materialize(featured(unlabelled), "unlabelled"))
        best = stored[0].select("doc_id", "content", "meta").mapInArrow(run, "view int, label int, sure double, doc_id long, content binary, meta binary")
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("sure"), "doc_id"))
        rows = best.withColumn("place", place).where(F.col("place") <= F.when(F.col("label") == 1, shares[1]).otherwise(shares[0]))
        rows = rows.where(F.col("place") <= max(shares)).orderBy("view", F.desc("label"), "place").collect()  # PER_ROUND rows a view, and one more
        return [(r.view, r.label, r.sure, r.doc_id, *(np.frombuffer(r[c], dtype=np.float32) for c in ("content", "meta"))) for r in rows]

    return pick


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Fits on at most labelled rows of labels, in the order of a hash of the id, and on pseudo-labels out of all other documents.

    Of documents that repeat an id each counts as unlabelled; of a labelled id one does, with the least features.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rated = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = rated.join(docs.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = featured(docs.join(F.broadcast(taken), "doc_id")).groupBy("doc_id", "quality").agg(F.min(F.struct("content", "meta")).alias("f")).select("doc_id", "quality", "f.*").orderBy("doc_id").toPandas()  # labelled rows at most
    rest = docs.where("doc_id IS NOT NULL").join(F.broadcast(taken.select("doc_id")), "doc_id", "left_anti").withColumn("quality", F.lit(-1))
    held = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 0).to_numpy(dtype=bool)
    return co_train(_read(rows["content"], SIZES[0]), _read(rows["meta"], SIZES[1]), rows["quality"].to_numpy(dtype=float), held, picker(rest))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with p_content, p_meta, quality_score (double) and good (boolean); only text, lang, source and n_chars are read."""
    names = ["p_content", "p_meta", "quality_score", "good"]
    kept = [c for c in docs.columns if c not in names]
    at = [kept.index(c) for c in ("text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            text, lang, source, n_chars = (batch.column(i) for i in at)
            content = np.stack([content_features(t.as_py()) for t in text]) if len(batch) else np.zeros((0, SIZES[0]))
            meta = np.stack([meta_features(a, b, c) for a, b, c in zip(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist(), strict=True)]) if len(batch) else np.zeros((0, SIZES[1]))
            p = model.scores(content, meta)
            yield [*batch.columns, *(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= threshold)]

    return over_columns(docs, kept, run, list(zip(names, ("double", "double", "double", "boolean"), strict=True)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs scored by a model trained on labels (doc_id, quality 0 or 1): see score().

    Null text, language, source and length have features of their own; empty texts have no content. Labels that are null or
    other than 0 and 1 take no part; of labels that repeat an id the lower counts; repeated documents score alike. With labels
    of one class or none every document gets their mean (1 without labels) and no model decides. An empty table gives no
    rows. Ids of docs and labels are cast to long for the fit, and ids that aren't numbers fail. Other columns pass through;
    columns named like the results are replaced.
    """
    return score(docs, train(docs, labels), threshold)
