"""Copies, near copies, repeated lines and passages, top-k and SentencePiece against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from rasterflow.llm import exact_dedup, line_dedup, near_dedup, sentencepiece_text, substring_dedup, topk
from rasterflow.llm.common import powers, rolling, table, word_hashes

from .fixtures import SF, documents, no_documents, prose

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_exact_dedup(spark):
    docs = documents(spark)
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups["".join(SPLIT.findall(t or ""))].append((-len(t or ""), i if i is not None else 1 << 60))
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows_of(docs))
    for i, t in rows_of(docs):
        norm = "".join(SPLIT.findall(t or ""))
        best = min(groups[norm])
        found = [r for r in got if r.doc_id == i and r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        assert found
        for r in found:
            assert r.group_size == len(groups[norm])
            if best[1] < 1 << 60:
                assert r.keep_id == best[1] and (not r.kept or i == best[1])
    assert exact_dedup.exact_dedup(no_documents(spark)).count() == 0


@pytest.mark.parametrize("weak", [lambda c: F.length(c), lambda c: F.lit(0)])
def test_identifiers_are_verified(spark, monkeypatch, weak):
    """Identifiers under which chunks collide are found and replaced, and the recipes alone decide."""
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(-(2**63), "one two"), (2**63 - 1, "one  two"), (700, "two one")], "doc_id long, text string"))
    want = Counter(exact_dedup.exact_dedup(docs).collect())
    monkeypatch.setattr(exact_dedup, "IDENTIFIERS", (weak, exact_dedup.itself))
    assert Counter(exact_dedup.exact_dedup(docs).collect()) == want
    monkeypatch.setattr(exact_dedup, "IDENTIFIERS", (weak,))
    assert Counter(exact_dedup.exact_dedup(docs).collect()) != want
    by_id = {r.doc_id: r for r in want}
    assert by_id[-(2**63)].keep_id == 2**63 - 1 and by_id[700].group_size == 1


def test_chunks_cover_texts(spark):
    long = prose(9, 5000)
    df = spark.createDataFrame([(1, long), (2, "x" * 10000), (3, "")], "doc_id long, text string")
    for r in df.select("text", exact_dedup.chunks(F.col("text")).alias("c")).collect():
        assert "".join(r.c) == r.text


def test_line_dedup(spark):
    texts = {0: "a\nb\nc\nd", 1: "x\na\nb\nc\ny", 2: "a\nb\nc", 3: "q\nq\nq\nq\nq", 4: None, 5: "", 6: "a\nb", 7: "a\nb\nc\nd"}
    df = spark.createDataFrame([(i, t, i, "z") for i, t in texts.items()] + [(None, "a\nb\nc", 0, "z")], "doc_id long, text string, n_lines int, a string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == ("a\nb\nc\nd", 4, 0) and got[1] == ("x\ny", 5, 3) and got[2] == ("", 3, 3) and got[7] == ("", 4, 4)
    assert got[3] == ("", 5, 4) or got[3] == ("q", 5, 4)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[6] == ("a\nb", 2, 0) and got[None] == ("a\nb\nc", 3, 0)
    assert line_dedup.dedup_lines(documents(spark)).count() == documents(spark).count()
    assert line_dedup.dedup_lines(no_documents(spark)).count() == 0


def brute_repeats(texts):
    words = [SPLIT.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_substring_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    docs = documents(spark)
    rows = rows_of(docs)
    want = Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()) == want
    assert substring_dedup.remove_repeats(no_documents(spark)).count() == 0


def test_hashes_depend_on_words_alone():
    a, b = word_hashes(b"one two  three one"), word_hashes(b"\n one\ttwo three")
    assert a[0] == a[3] == b[0] and a[2] == b[2] and len(set(a.tolist())) == 3 and len(word_hashes(b" \n")) == 0
    h = word_hashes(prose(5, 500).encode())
    one, two = substring_dedup.window_hashes(h, 35)
    again, _ = substring_dedup.window_hashes(h[7:], 35)
    assert (one[7:] == again).all() and (one != two).all() and (rolling(h, 5)[7:] == rolling(h[7:], 5)).all()


def test_windows_and_anchors_by_brute_force():
    """Hashes from kept powers are those of the words, and anchors the least phrases of each window."""
    r = np.random.default_rng(3)
    for data in (prose(6, 400).encode(), b"a b " * 90, "é 日本 🙂 ".encode() * 30, bytes(r.choice(np.frombuffer(b"ab \t", dtype=np.uint8), 200_000))):
        h = word_hashes(data)
        assert (h[:60] == [word_hashes(w)[0] for w in data.split()[:60]]).all()
        phrase = rolling(h, substring_dedup.PHRASE)[:3000]
        spread = substring_dedup.WINDOW - substring_dedup.PHRASE + 1
        want = {i + j for i in range(len(phrase) - spread + 1) for j in np.flatnonzero(phrase[i : i + spread] == phrase[i : i + spread].min()).tolist()}
        assert want == set(substring_dedup.anchors(h[: len(phrase) + substring_dedup.PHRASE - 1]).tolist())
    assert powers(5, 10)[0].base is powers(5, 900)[0].base and (powers(5, 900)[0] * powers(5, 900)[1] == 1).all()


def test_automaton_nodes_have_few_edges():
    """Phrases start at whole words, and no node has an edge for each word."""
    phrases = [b" ".join(b"w%d" % (i * 8 + k) for k in range(8)) for i in range(500)]
    spelt, found = substring_dedup.automaton(phrases)
    assert len({c for s in spelt.values() for c in s}) < 60 and len(set(spelt.values())) == 4000
    words = [b"other", *phrases[7].split(b" "), b"other", *phrases[3].split(b" ")[1:], *phrases[8].split(b" ")]
    text = "".join(spelt.get(w, "\0" * substring_dedup.DIGITS) for w in words)
    assert [(end // substring_dedup.DIGITS, k) for end, k in found.iter(text)] == [(8, 7), (24, 8)]


def test_texts_that_differ_in_white_space(spark):
    words = prose(8, 50).split()
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(words)), (3, " ".join(words)), (4, " ".join(words[:34]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()} == {1: (50, 50), 2: (50, 50), 3: (50, 50), 4: (34, 0)}


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    link = defaultdict(set)
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                link[i].add(j)
    comp = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i in comp:
            low = min((comp[j] for j in link[i]), default=comp[i])
            if low < comp[i]:
                comp[i], changed = low, True
    return {i: len(s) for i, s in sets}, comp


def near_copies(seed, n, edits):
    r = np.random.default_rng(seed)
    base = prose(seed, 150).split()
    out = []
    for k in range(n):
        words = list(base)
        for at in r.choice(len(words), r.integers(0, edits), replace=False):
            words[at] = f"w{seed}x{k}x{at}" if r.random() < 0.8 else f"v{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("short", [16, 2])
def test_near_components(spark, monkeypatch, short):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    docs = documents(spark).select("doc_id", "text")
    texts = near_copies(11, 60, 14) + near_copies(12, 40, 8)
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = rows_of(docs)
    sizes, comp = brute_components(rows)
    got = near_dedup.near_components(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id), r.doc_id
    assert near_dedup.near_components(no_documents(spark)).count() == 0
    left = near_dedup.without_near_duplicates(docs)
    assert left.count() == sum(r.kept for r in got)


def test_a_large_group_without_all_pairs(spark, monkeypatch):
    """2,000 edited copies, among them copies of one copy, and as many short texts around one passage: right components from few pairs."""
    base = near_copies(21, 1, 1)[0].split()
    far = [f"z{i}" if i % 3 == 0 else w for i, w in enumerate(base)]
    r = np.random.default_rng(5)
    texts = []
    for k in range(2000):
        words = list(far if k % 4 == 0 else base)
        for at in r.choice(len(words), r.integers(0, 12), replace=False):
            words[at] = f"e{k}x{at}" if r.random() < 0.7 else f"shared{at}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{k}x{i}" for i in range(r.integers(0, 40))) for k in range(2000)]
    sets = [near_dedup.shingle_set(t) for t in texts]
    number = {v: i for i, v in enumerate(np.unique(np.concatenate(sets)).tolist())}
    rows = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        rows[i, [number[v] for v in s.tolist()]] = 1
    size, comp = rows.sum(axis=1), np.arange(len(sets))
    shared = rows @ rows.T
    linked = 4 * shared >= 3 * (size[:, None] + size[None, :] - shared)
    while True:
        low = np.where(linked, comp[None, :], len(sets)).min(axis=1)
        if (low == comp).all():
            break
        comp = low
    seen = []
    real = near_dedup.likely
    monkeypatch.setattr(near_dedup, "likely", lambda pairs, short: seen.append(pairs.count()) or real(pairs, short))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(docs).collect()}
    assert got == dict(enumerate(comp.tolist())) and len(set(comp.tolist())) > 2
    assert sum(seen) < 20 * len(texts), "candidate pairs grow with the members, not with their square"


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 0, -1)] + [(50, 40)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 22)}, 40: 40, 50: 40}


def test_top_k(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(150)] + [(200 + i, [0.25] * 8) for i in range(30)]
    vectors += [(300, None), (301, [0.1, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [0.1] * 8), (305, [1.0, 2.0]), (320, [1.0, 1.0])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for row in topk.top_k(df, df.where("vec_id % 20 = 0"), k=20, block=40, query_block=4).collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    whole = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 20 == 0):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 1 << 20, 1 << 28, 1 << 30])
def test_bounds_leave_out_what_cannot_qualify(size):
    """Exact at any size of components and of blocks; with a floor, items under it are not scored."""
    r = np.random.default_rng(size)
    items, queries = r.integers(-size, size, (300, 6)), r.integers(-size, size, (9, 6))
    for n in (0, 1, 19, 300):
        own = np.zeros((9, n), dtype=bool)
        own[:, : n // 10] = True
        row, item, score = topk.nra(queries, items[:n], own, 20)
        whole = queries @ items[:n].T
        assert (score == whole[row, item]).all() and not own[row, item].any()
        for i in range(9):
            want = np.sort(whole[i][~own[i]])[::-1][:20]
            assert (np.sort(score[row == i])[::-1][: len(want)] == want).all()
    floors = np.sort(whole, axis=1)[:, -50]
    row, _, score = topk.nra(queries, items, own, 20, floors)
    assert all((np.sort(score[row == i])[-3:] == np.sort(np.where(own[i], -(2**62), whole[i]))[-3:]).all() for i in range(9))
    assert len(row) <= len(topk.nra(queries, items, own, 20)[0])


def test_sentencepiece(spark):
    docs = documents(spark)
    model = SentencePieceProcessor(model_file=sentencepiece_text.default_model())
    coded = sentencepiece_text.decode(sentencepiece_text.encode(docs)).collect()
    for r in coded:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == model.encode(r.text) and r.decoded == model.decode(r.ids)
    assert sentencepiece_text.encode(no_documents(spark)).count() == 0


def test_sentencepiece_query_in_one_process(spark):
    # Encoding and decoding in steps of their own take two Python workers for each task, and twice the memory.
    from rasterflow.llm import queries

    found = queries.op1_sentencepiece(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = sentencepiece_text.decode(sentencepiece_text.encode(docs))
    assert sorted(found.select("doc_id", "ids", "n_tokens", "round_trip").collect()) == sorted((r.doc_id, r.ids, len(r.ids), r.decoded == r.text) for r in own.collect())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a\u00e9\u4e2d  b"), (4, "\u2581x")], "doc_id long, text string")
    assert sorted(sentencepiece_text.encode(odd, decoded_col="decoded").collect()) == sorted(sentencepiece_text.decode(sentencepiece_text.encode(odd)).collect())


def test_sentencepiece_search(monkeypatch):
    vocab = sentencepiece_text.vocabulary(sentencepiece_text.default_model())
    model = SentencePieceProcessor(model_file=sentencepiece_text.default_model())
    texts = ["  a  b\n\tc  ", " " * 40 + "word", "▁a ▁▁b", "<s> <0x0A> <unk>", "\x00\x01​", *(" " * n + "日" for n in range(1, 40))]
    assert [i.tolist() for i in vocab.encode(texts)] == [model.encode(t) for t in texts]
    best = sentencepiece_text.Vocabulary(sentencepiece_text.default_model(), "unigram")
    best.ids, best.scores = {"a": 3, "b": 4, "ab": 5, "ba": 6, "aba": 7}, {"a": -1.0, "b": -2.0, "ab": -1.5, "ba": -2.6, "aba": -3.0}
    best.pieces = ["", "", "", "a", "b", "ab", "ba", "aba"]
    best.grow()

    def brute(word):
        if not word:
            return 0.0, []
        return max(((s + best.scores[p], [best.ids[p], *rest]) for p in best.ids if word.startswith(p) for s, rest in [brute(word[len(p) :])]), default=(-1e9, []))

    words = sorted({"".join(x) for n in range(1, 7) for x in __import__("itertools").product("ab", repeat=n)})
    score = lambda ids: sum(best.scores[best.pieces[i]] for i in ids)
    assert all(abs(score(got) - brute(w)[0]) < 1e-9 for w, got in zip(words, best.forward(words), strict=True))


def test_words_of_the_last_step_stay_known(monkeypatch):
    """Words of two steps in turn aren't searched again, however many there are."""
    monkeypatch.setattr(sentencepiece_text, "CACHE", 3)
    vocab = sentencepiece_text.Vocabulary(sentencepiece_text.default_model())
    model = SentencePieceProcessor(model_file=sentencepiece_text.default_model())
    searched, search = [], vocab.search
    monkeypatch.setattr(vocab, "search", lambda words: searched.append(words) or search(words))
    texts = [" ".join([prose(5, 40), *(f"w{k}" for k in range(n)), "日本 ", "   x  "]) for n in range(1, 6)]
    for n, t in enumerate(texts, 1):
        assert vocab.encode([t])[0].tolist() == model.encode(t)
        assert n == 1 or searched[-1] == [f"▁w{n - 1}"]


def test_on_the_smallest_table(spark):
    docs = table(spark, SF, "documents")
    rows = rows_of(docs)
    want = dict(zip([i for i, _ in rows], brute_repeats([t for _, t in rows]), strict=True))
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in substring_dedup.remove_repeats(docs).collect())
    sizes, comp = brute_components(rows)
    assert all((r.n_shingles, r.component_id) == (sizes[r.doc_id], comp[r.doc_id]) for r in near_dedup.near_components(docs).collect())
