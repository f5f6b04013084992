"""Spelling variants, source divergence and the n-gram join against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.llm import divergence, ngram_join, spelling
from rasterflow.llm.near_dedup import ratio, shingle_set

from .fixtures import SCHEMA, documents, no_documents


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def small(spark, texts, lang=None, source=None):
    rows = [(i, t, lang[i] if lang else "en", source[i] if source else "s", 1, "k", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# --- spelling ------------------------------------------------------------------------------------


def plain_groups(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


def variants(seed, rare=6):
    """Documents of words over few letters, so that edits of all kinds and chains of forms occur."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(30)]
    words = []
    for k, w in enumerate(stems):
        i = r.randrange(len(w))
        words += [w] * (5 ** (k % 4) + 5) + [w[:i] + w[i + 1 :]] * 7 + [w[:i] + "b" + w[i:]] * (k % 9) + [w[:i] + "ÿ" + w[i + 1 :]] * rare
        if k % 4 == 3:
            words += [f"{w}ÿ"] * 26 + [f"{w}ÿc"] * 5
    r.shuffle(words)
    return [" ".join(words[i : i + 50]).title() if i % 3 else "-".join(words[i : i + 50]) for i in range(0, len(words), 50)]


@pytest.mark.parametrize("shard,hot", [(20_000, 10_000), (7, 10_000), (9, 2)])
def test_spelling(spark, shard, hot, monkeypatch):
    texts = variants(3)
    monkeypatch.setattr(spelling, "near_words", lambda words, f=spelling.near_words: f(words, shard, hot))
    got = [tuple(r) for r in spelling.spelling_groups(small(spark, texts)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_groups(enumerate(texts))
    assert set(got) == want and len(got) == len(want)
    assert any(f for _, f, *_ in want) and any(r not in (w, f) for w, f, r, *_ in want)


def test_spelling_hard_rows(spark):
    docs = documents(spark)
    got = {tuple(r) for r in spelling.spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_groups((r.doc_id, r.text) for r in docs.collect())
    assert spelling.spelling_groups(no_documents(spark)).count() == 0


def test_one_edit_shares_one_shortened_string():
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(60)]
    for a in words:
        for b in words:
            common = spelling.one_deletion(a) & spelling.one_deletion(b)
            if spelling.one_edit(a, b):
                assert len(common) == 1


# --- divergence ----------------------------------------------------------------------------------


def plain_divergence(rows):
    count, in_docs, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = Counter(lower(t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        for t, n in own.items():
            count[lang, source, t] += n
            in_docs[lang, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= 3)
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}

        def share(c, of, v=len(kept)):
            return 1 + 1_000_000_000 * (c + 1) // (of + v)

        for s in sources:
            p = {t: share(count[lang, s, t], total[s]) for t in kept}
            parts = {"pair": [], "term": []}
            for o in sources - {s}:
                q = {t: share(count[lang, o, t], total[o]) for t in kept}
                parts["pair"].append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o))
            for t in kept:
                q = share(sum(count[lang, o, t] for o in sources), sum(total.values()))
                if count[lang, s, t] and p[t] > q:
                    parts["term"].append(((p[t] - q) ** 2 // q, t))
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= 200}
    return out


def sourced(spark):
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["é", "É", "日本"]
    texts, lang, source = [], [], []
    for i in range(160):
        texts.append(" ".join(r.choice(words if i % 7 == 0 else words[:60]) for _ in range(r.randint(0, 300))))
        lang.append(["en", "de", None, "xx"][i % 7 % 4])
        source.append([f"s{k}" for k in range(7)][i % 7] if i % 11 else None)
    # A language that keeps no term, one of a single source, one group without text.
    texts += ["only once", "never again", None, "lone lone", ""]
    lang += ["zz", "zz", "zz", "single", "en"]
    source += ["a", "b", "c", "a", "quiet"]
    return small(spark, texts, lang, source)


@pytest.mark.parametrize("block,strip", [(8192, 128), (50, 3)])
def test_divergence(spark, block, strip):
    docs = sourced(spark)
    got = [tuple(r) for r in divergence.source_divergence(docs, block=block, strip=strip).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = plain_divergence((r.lang, r.source, r.text) for r in docs.collect())
    assert set(got) == want and len(got) == len(want)
    assert any(part == "term" and k == 200 for _, _, part, _, _, k in want) and ("zz", "a", "pair", "b", 0, 1) in want


def test_divergence_hard_rows(spark):
    docs = documents(spark)
    got = {tuple(r) for r in divergence.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain_divergence((r.lang, r.source, r.text) for r in docs.collect())
    assert divergence.source_divergence(no_documents(spark)).count() == 0


def test_shares_are_exact_for_large_counts():
    count, total, terms = [0, 7 * 10**14, 9 * 10**14], 9 * 10**14, 10**8
    got = divergence.shares(np.array(count), np.array([total]), terms).tolist()
    assert got == [1 + 1_000_000_000 * (c + 1) // (total + terms) for c in count]


# --- n-gram join ---------------------------------------------------------------------------------


def plain_components(rows, percent=80):
    sets = defaultdict(list)
    for doc, text in rows:
        words = lower(text or "").encode().split()
        s = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        sets[doc].append(s)
    ids = [d for d in sets if d is not None]
    comp = {d: d for d in ids}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                a_root, b_root = root(a), root(b)
                comp[max(a_root, b_root)] = min(a_root, b_root)
    return {d: root(d) for d in ids}


def edited(seed):
    """Texts of all sizes with copies whose similarity lies around the threshold."""
    r = random.Random(seed)
    texts = []
    for size in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 20, 25, 31, 40, 60, 90, 140, 300):
        base = [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(size)]
        texts.append(" ".join(base))
        for edits in range(1, 2 + size // 20):
            changed = base[:]
            for _ in range(edits):
                changed[r.randrange(len(changed))] = f"new{r.randrange(9)}"
            texts += [" ".join(changed), " ".join(base + ["more"] * edits), " ".join(base[edits:])]
    return texts


def test_join(spark):
    texts = edited(2) + edited(7)
    got = ngram_join.jaccard_join(small(spark, texts)).collect()
    want = plain_components(enumerate(texts))
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(texts)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t)) for i, t in enumerate(texts)}
    assert 5 < len(set(want.values())) < len(texts)


def test_join_of_large_group_of_edited_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        changed = base[:]
        for _ in range(r.randint(0, 5)):
            changed[r.randrange(120)] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(changed))
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_join(small(spark, texts)).collect()}
    assert got == plain_components(enumerate(texts))


@pytest.mark.parametrize("alike,deep", [(0, 512), (10**6, 512), (4, 17), (4, 4096)])
def test_lists_as_pairs_and_as_groups(spark, monkeypatch, alike, deep):
    """Sixty texts around each of two passages that half of their words are, and thirty edited copies: lists over SHORT of both kinds."""
    monkeypatch.setattr(ngram_join, "ALIKE", alike)
    monkeypatch.setattr(ngram_join, "LONG", deep)
    r = random.Random(8)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(2)]
    texts = [f"{passages[i % 2]} {' '.join(f'o{r.randrange(10**6)}' for _ in range(r.randint(5, 12)))}" for i in range(120)]
    texts += [" ".join(w if r.random() > 0.01 else "edit" for w in texts[0].split()) for _ in range(30)]
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_join(small(spark, texts)).collect()}
    assert got == plain_components(enumerate(texts))


def test_clusters_lose_no_pair():
    """Each pair of like profiles is given, or both are in one cluster."""
    r = np.random.default_rng(5)
    for n, kinds in ((20, 1), (60, 3), (100, 40), (80, 80), (200, 6)):
        middle = r.integers(0, 12, (kinds, ngram_join.BUCKETS))
        profiles = np.clip(middle[r.integers(0, kinds, n)] + r.integers(-1, 2, (n, ngram_join.BUCKETS)) * (r.random((n, 1)) < 0.6), 0, 255).astype(np.int16)
        size = profiles.sum(axis=1).astype(np.int64)
        pairs, cluster = ngram_join.clusters(size, profiles, 80)
        given = {tuple(sorted(p)) for p in pairs.tolist()}
        for i in range(n):
            for j in range(i):
                if np.abs(profiles[i] - profiles[j]).sum(dtype=np.int64) * 9 <= size[i] + size[j]:
                    assert (j, i) in given or cluster[i] == cluster[j] >= 0
        assert len(given) == len(pairs) <= ngram_join.ALIKE * n


def test_profiles_of_sets_of_any_size():
    """A profile never gives more than the difference, and rules out large sets that have nothing or half of their elements in common."""
    r = np.random.default_rng(11)
    draw = lambda n: np.unique(r.integers(-(2**63), 2**63 - 1, n))
    for size in (1, 30, 400, 1024, 1025, 2000, 5000, 9000):
        for other, common in ((size, 0), (size, size // 2), (size, size), (size * 5 // 4, size), (size * 4 // 5, size * 3 // 4)):
            shared = draw(common)
            a, b = (np.unique(np.concatenate((shared, draw(n - common)))) for n in (size, max(other, common)))
            apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
            least = ngram_join.differing([ngram_join.profile(a)], [ngram_join.profile(b)])[0]
            assert least <= apart
            if 400 <= size and common <= size // 2:
                assert least * ratio(80) > len(a) + len(b)


def test_lists_of_large_unlike_sets_are_no_cluster(spark):
    """Sets of thousands of elements that share a signature and little more give neither pairs nor members of a cluster; those with like sets do, whatever the sizes beside them."""
    r = np.random.default_rng(12)
    draw = lambda n: np.unique(r.integers(-(2**63), 2**63 - 1, n))
    sets = [draw(int(n)) for n in r.integers(3500, 6000, 40)]
    sets += [np.sort(np.concatenate((sets[0][50:], draw(60)))), np.sort(np.concatenate((sets[1][:-90], draw(9))))]
    rows = [(7, i, len(s), ngram_join.profile(s)) for i, s in enumerate(sets)]
    found = ngram_join.compared_lists(spark.createDataFrame(rows, "value long, rep long, size long, profile binary"), 80).collect()
    assert sorted((x.a, x.b) for x in found) == [(0, 40), (1, 41)]


def test_join_hard_rows(spark):
    docs = documents(spark)
    rows = ngram_join.jaccard_join(docs).collect()
    want = plain_components((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == docs.count()
    assert all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in rows)
    assert ngram_join.jaccard_join(no_documents(spark)).count() == 0
    odd = docs.select(F.col("doc_id").alias("the.id"), F.col("text").alias("a.text"), F.lit(1).alias("value"), F.lit(2).alias("rep"))
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_join(odd, "the.id", "a.text").collect()} == {(r.doc_id, r.component_id) for r in rows}


def test_linked_sets_share_a_signature():
    """Random pairs at the threshold, for every size of a small set and some large ones."""
    r = np.random.default_rng(3)
    c = ratio(80)
    for size in [*range(4, 60), 100, 333, 1000, 4000]:
        for _ in range(40 if size < 60 else 8):
            room = r.integers(0, max(1, size // 4 + 1))
            common = size - int(r.integers(0, size // 5 + 1))
            a = np.unique(r.integers(-(2**63), 2**63 - 1, size))
            b = np.unique(np.concatenate((a[:common], r.integers(-(2**63), 2**63 - 1, room))))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 80 * (len(a) + len(b) - inter) and len(a) + len(b) - 2 * inter:
                assert len(a) + len(b) - 2 * inter <= (len(a) + len(b)) // c
                assert np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)).size


def test_weak_sets_go_on_to_other_partitions(monkeypatch):
    """Every set counts as weak: the single elements still give shared signatures, and so does each further partition."""
    found = ngram_join._partitioned
    monkeypatch.setattr(ngram_join, "_partitioned", lambda *a: (found(*a)[0][:0], 0))
    a = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50))
    assert np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(a[:45])).size >= 45
