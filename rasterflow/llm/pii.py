"""Personal data by weak supervision.

Three labelers propose candidates of four kinds (email, ip, card, phone) and vote on all of them: the pattern with its own
rule (regex), lists of known prefixes and domains (gazetteer), and the words around (context). The gazetteer also proposes
addresses that are spelt out before a known domain and numbers that dial a known country by 00, the context labeler numbers
that follow a word for them. Expectation-maximisation over the counts of all vote patterns estimates each labeler's
reliability; its posteriors train a logistic span classifier on the candidates' features. Both work on counts over the whole
corpus, whose number of rows is bounded by the feature values. The classifier then adds spans that the patterns' rules drop
or that the other labelers propose; spans that pass the rules always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, over_columns

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the contract's patterns, written so that they take linear time on any text.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LAST = re.compile(r"[A-Za-z0-9-]*\Z")
#: Code points from the end in which LAST is looked for; no known domain is as long.
TAIL = 16
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Gazetteers: top-level domains, calling codes, card issuers' prefixes.
TLDS = frozenset("com org net edu gov int io info biz app dev de fr es it uk nl be ch at pt eu us ca mx br ar au nz jp cn in kr ru pl se no dk fi".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "351", "352", "353", "354", "358", "380", "420", "421", "971", "972")
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "35", "36", "38", "6011", "64", "65")
#: Words that stand before such data.
CONTEXT = re.compile(r"(?i)e-?mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|iban|account|server|host|address|\bip\b|correo|kontakt|anruf|appel|carte|tarjeta|karte")
AGAINST = re.compile(r"(?i)version|build|commit|hash|token|secret|password|isbn|issn|chapter|page|section|figure|sha|md5|[=#/\\$]\s*\Z")
#: What the gazetteer proposes: an address that is spelt out around one of these, its last part a known domain; a number that dials abroad by 00.
AT = (" at ", "(at)", "[at]")
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)([A-Za-z]{2,6})(?![A-Za-z0-9])")
#: What the context labeler proposes: a number that follows a word for it.
NUMBER = re.compile(r"[0-9(][0-9\x20().-]{5,24}[0-9](?![0-9])")
CALLED = re.compile(r"(?i)\b(?:phone|telephone|tel|call|mobile|cell|fax|telefon|tel\u00e9fono|t\u00e9l\u00e9phone|t\u00e9l|anruf|appel)\b[^0-9A-Za-z+\n]{0,4}\Z")
PAID = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|carte|karte|tarjeta)\b[^0-9\n]{0,12}\Z")
#: Code points before and after a candidate that the context labeler sees.
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def candidates(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether the pattern's own rule holds), kinds in order, leftmost and without overlap within a kind."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL_CHARS:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            yield 0, left, m.end(), True
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(p.lstrip("0")) < 4 and int(p[-9:]) < 256 for p in m[0].split("."))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 9:
            yield 2, m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield 3, m.start(), m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15


def proposals(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Candidates of the gazetteer and the context labeler, in the form of candidates(); the pattern's rule holds for none."""
    for sign in AT:
        at = text.find(sign)
        while at >= 0:
            end = at + 4 + (sign[0] != " " and text[at + 4 : at + 5] == " ")
            left = start = at - (sign[0] != " " and text[max(0, at - 1) : at] == " ")
            while left > max(0, start - 64) and text[left - 1] in LOCAL_CHARS:
                left -= 1
            domain = SPELT_DOMAIN.match(text, end) if left < start and (not left or text[left - 1] not in LOCAL_CHARS) else None
            if domain and domain[1].lower() in TLDS:
                yield 0, left, domain.end(), False
            at = text.find(sign, at + 1)
    if not DIGIT.search(text):
        return
    for m in NUMBER.finditer(text):
        start, digits = m.start(), digits_of(m[0])
        if start and text[start - 1] in "0123456789+.-":
            continue
        before = text[max(0, start - REACH) : start]
        if digits.startswith("00") and digits[2:].startswith(CALLING) and 11 <= len(digits) <= 17 or 7 <= len(digits) <= 15 and CALLED.search(before):
            yield 3, start, m.end(), False
        if 12 <= len(digits) <= 19 and PAID.search(before):
            yield 2, start, m.end(), False


def labelled_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """What any labeler proposes, by kind and start. What overlaps a span whose rule holds gives way, and a proposal to a pattern's span of its kind."""
    own = list(candidates(text))
    more = sorted(set(proposals(text)))
    firm = disjoint(sorted((a, b) for _, a, b, rule in own if rule))
    out = [c for c in own if c[3] or clear(c, firm)]
    for kind in {c[0] for c in more}:
        spans = disjoint(sorted((a, b) for k, a, b, rule in own if rule or k == kind))
        for c in more:
            if c[0] == kind and clear(c, spans):
                out.append(c)
                insert(c, spans)
    return sorted(out)


def clear(c: tuple[int, int, int, bool], spans: list[tuple[int, int]]) -> bool:
    """Whether c overlaps none of the sorted disjoint spans."""
    i = bisect.bisect_left(spans, (c[2],))
    return not i or spans[i - 1][1] <= c[1]


def insert(c: tuple[int, int, int, bool], spans: list[tuple[int, int]]) -> None:
    bisect.insort(spans, c[1:3])


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def features(text: str, kind: int, start: int, end: int, rule: bool) -> tuple[int, ...]:
    """(kind, votes of regex, gazetteer and context, alphanumeric before, after, separators, digits): small integers all."""
    body = text[start:end]
    digits = digits_of(body)
    if kind == 0:
        known = LAST.search(body[-TAIL:])[0].lower() in TLDS
    elif kind == 1:
        known = 1 <= int(body.split(".")[0][-9:] or 0) <= 223
    elif kind == 2:
        known = digits.startswith(ISSUERS)
    else:
        known = digits.removeprefix("00").startswith(CALLING)
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    context = -1 if AGAINST.search(before) else 1 if CONTEXT.search(before) or CONTEXT.search(after) else 0
    return kind, 1 if rule else -1, 1 if known else -1, context, int(before[-1:].isalnum()), int(after[:1].isalnum()), int(len(body) > len(digits)), min(len(digits), 20)


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each vote pattern (rows of -1, 0, 1), the prior, and each labeler's table [labeler, truth, vote + 1]."""
    post = 1 / (1 + np.exp(-2.0 * votes.sum(axis=1)))
    table, prior = np.full((votes.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.02, 0.98))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = weight[:, votes[:, j] == v].sum(axis=1) + np.where(np.array([0, 1]) == (v > 0), 2.0, 1.0)
            table[j] /= table[j].sum(axis=1, keepdims=True)
        log = np.log([1 - prior, prior])[:, None] + sum(np.log(table[j][:, votes[:, j] + 1]) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, prior, table


def vector(keys: np.ndarray) -> np.ndarray:
    """Feature rows of the classifier: a constant, the votes one by one, the borders, separators, and bands of digit counts."""
    votes = [(keys[:, j] == v).astype(float) for j in (1, 2, 3) for v in (-1, 1)]
    bands = [(keys[:, 7] >= n).astype(float) for n in (9, 11, 13, 16, 20)]
    return np.stack([np.ones(len(keys)), *votes, *(keys[:, j].astype(float) for j in (4, 5, 6)), *bands], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, text_col: str = "text") -> dict[int, np.ndarray]:
    """The span classifier's weights by kind, from counts of feature patterns over all of docs."""
    names = ["kind", "regex", "gazetteer", "context", "before", "after", "separated", "digits"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py() or ""
                seen.update(features(t, *c) for c in labelled_spans(t))
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in seen], pa.int32()) for i in range(8)), pa.array(list(seen.values()), pa.int64())], [*names, "n"])

    rows = docs.select(named(docs, text_col).alias("text")).mapInArrow(count, ", ".join(f"{c} int" for c in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n")).toPandas().sort_values(names)  # 10,000 feature patterns at most
    model = {}
    for kind, own in rows.groupby("kind"):
        keys, n = own[names].to_numpy(), own["n"].to_numpy(dtype=float)
        post, _, _ = em(keys[:, 1:4], n)
        model[int(kind)] = logistic(vector(keys), post, n)
    return model


def find(text: str, model: dict[int, np.ndarray]) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base): spans that pass their rule, and those that the classifier adds; of added ones that overlap the likeliest."""
    spans = labelled_spans(text)
    out = [c for c in spans if c[3]]
    scored = [(float(vector(np.array([features(text, *c)]))[0] @ model[c[0]]), c) for c in spans if not c[3] and c[0] in model]
    taken: list[tuple[int, int]] = []
    for _, c in sorted(((-x, c) for x, c in scored if x > 0)):
        if clear(c, taken):
            out.append(c)
            insert(c, taken)
    return sorted(out)


def spell(spans: list[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (long), base_sha256, spans, n_added (long): one row for each row of docs.

    spans is kind:start:end by kind, then start, comma-joined, in code points, end exclusive. Counts and digest are of the
    base spans; n_added counts the others. Ids are cast to long, and ids that aren't numbers fail. A null or empty text has none: counts of 0 and the digest of the empty string. Repeated rows have equal
    values. An empty table gives no rows; further columns are ignored.
    """
    model = fit(docs, text_col) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                spans = find(text.as_py() or "", model)
                base = [s for s in spans if s[3]]
                n = Counter(s[0] for s in base)
                out.append((*(n[k] for k in range(4)), hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans), len(spans) - len(base)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    return docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_pii(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """docs with the found spans masked in the text; nulls stay null, all other columns pass through."""
    model = fit(docs, text_col) if model is None else model
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            texts = [t and mask(t, find(t, model)) for t in batch.column(at).to_pylist()]
            yield [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]

    return over_columns(docs, docs.columns, run)
