"""Columns whose names clash with what the operators use inside, names with dots, and the ends of the id range."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from rasterflow.llm import exact_dedup, line_dedup, near_dedup, packing, pii, quality, secret_scan, sentencepiece_text, substring_dedup, topk

from .fixtures import prose

NAMES = ("a.b", "__dropped", "gone", "group", "best", "lines", "cuts", "tid", "recipe", "norm", "block", "sig", "key", "value", "rep", "hub", "c0", "x0", "unlikely`name")


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(1, 60), prose(1, 60), "a\nb\nc\nd", "x\na\nb\nc", None, "", "mail to a@b.com"]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(-(2**63), prose(2, 50), None, None, None), (2**63 - 1, prose(2, 50), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def passed(df, out, rows):
    """All columns of df are there with the values that they had."""
    assert set(df.columns) <= set(out.columns) and out.count() == rows
    for i, n in enumerate(NAMES):
        quoted = "`" + n.replace("`", "``") + "`"
        assert {r[0] for r in out.select(F.col(quoted)).distinct().collect()} == {i}


def test_columns_pass_through(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    passed(docs, line_dedup.dedup_lines(docs), 9)
    passed(docs, near_dedup.without_near_duplicates(docs), 7)
    passed(docs, sentencepiece_text.decode(sentencepiece_text.encode(docs)), 9)
    passed(docs, pii.mask_pii(docs), 9)
    passed(docs, quality.classify(docs, labels), 9)


def test_results_with_clashing_columns(spark, docs):
    plain = docs.select("doc_id", "text")
    for run in (exact_dedup.exact_dedup, secret_scan.scan_secrets, substring_dedup.remove_repeats, packing.pieces, pii.find_pii, near_dedup.near_components):
        assert Counter(map(tuple, run(docs).collect())) == Counter(map(tuple, run(plain).collect())), run.__name__


def test_top_k_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 1.0], 1, 2, 3) for i in range(30)] + [(40, [1e300, 1e300], 1, 2, 3)], "`vec.id` long, embedding array<double>, id int, v int, floor int")
    plain = df.where("`vec.id` < 40")
    rows = topk.top_k(plain, plain.where("`vec.id` = 3"), k=2, id_col="vec.id").collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(1, 29), (2, 28)]


def test_ends_of_the_id_range(docs):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[2**63 - 1].keep_id == -(2**63) and got[-(2**63)].kept and not got[2**63 - 1].kept
    near = {r.doc_id: r for r in near_dedup.near_components(docs).collect()}
    assert near[2**63 - 1].component_id == -(2**63)
