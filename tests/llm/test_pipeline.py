"""Each stage of the corpus pipeline against plain Python, on its own input from the smallest table."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from rasterflow.llm import packing, pii, quality
from rasterflow.llm.common import materialize, table

from .fixtures import SF, documents
from .test_dedup import brute_components


@pytest.fixture(scope="module")
def stages(spark):
    """name: (rows before, rows after) of each stage, as dictionaries."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()])
        docs = after
    return out


def same(rows, want):
    key = lambda r: repr(sorted(r.items()))
    assert Counter(map(key, rows)) == Counter(map(key, want))


def test_all_but_the_last_keep_the_columns(stages):
    for name, (_, after) in stages.items():
        assert name == "packing" or all(list(r) == corpus_pipeline.COLUMNS for r in after)


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    content, meta = (np.stack(x) for x in zip(*[(quality.content_features(r["text"]), quality.meta_features(r["lang"], r["source"], r["n_chars"])) for r in before], strict=True))
    good = model.scores(content, meta)[2] >= 0.5
    same(after, [r for r, g in zip(before, good, strict=True) if g])
    rated = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    clean = [r["doc_id"] for r in before if rated.get(r["doc_id"]) == 1]
    assert len({r["doc_id"] for r in after} & set(clean)) >= 0.95 * len(clean)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    seen, want = set(), []
    for r in sorted(before, key=lambda r: r["doc_id"]):
        lines, gone = r["text"].split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            gone |= {at, at + 1, at + 2} if window in seen else set()
            seen.add(window)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want.append({**r, "text": text, "n_chars": len(text)})
    same(after, want)


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    _, component = brute_components([(r["doc_id"], r["text"]) for r in before])
    same(after, [r for r in before if component[r["doc_id"]] == r["doc_id"]])


def test_personal_data_stage(spark, stages):
    before, after = stages["pii"]
    model = pii.fit(spark.createDataFrame([(r["text"],) for r in before], "text string"))
    masked = [pii.mask(r["text"], pii.find(r["text"], model)) for r in before]
    same(after, [{**r, "text": t, "n_chars": len(t)} for r, t in zip(before, masked, strict=True)])
    assert any(r["text"] != t for r, t in zip(before, masked, strict=True))


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    coder = Tokenizer.from_file(packing.tokenizer_params()["json"])
    want, filled = Counter(), defaultdict(list)
    for r in before:
        ids = np.array([*coder.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r["doc_id"], k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids))))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    for r in after:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        ends = np.cumsum([0, *(n for _, n in sorted(own))])
        assert [a for a, _ in sorted(own)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_stages_take_hard_rows(spark):
    """Nulls, empty and very long texts, repeated rows and no rows at all pass every stage."""
    for docs in (documents(spark).select(*corpus_pipeline.COLUMNS), documents(spark).select(*corpus_pipeline.COLUMNS).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() >= 0
