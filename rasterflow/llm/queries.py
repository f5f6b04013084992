"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, line_dedup, near_dedup, ngram_join, packing, pii, quality, secret_scan, sentencepiece_text, spelling, substring_dedup, topk
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_text.encode(docs, decoded_col="decoded")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_content", "p_meta", "quality_score", "good")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_topk, op3_substring_dedup, op4_quality, op5_line_dedup, op6_minhash, op7_packing, op8_secret_scan, op9_exact_dedup, op10_pii, op11_spelling, op12_divergence, op13_ngram_join)}

SQL = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
    "op3_substring_dedup": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), w AS MATERIALIZED (
  SELECT r, s, array_to_string(words[s:s + 34], ' ') AS passage FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 33, 1))) AS s FROM d)
), twice AS (
  SELECT passage FROM w GROUP BY passage HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM w SEMI JOIN twice USING (passage)
), each AS (
  SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d
), kept AS (
  SELECT each.r, count(*) AS n_words, count(covered.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY each.i) FILTER (WHERE covered.i IS NULL), '') AS text
  FROM each LEFT JOIN covered ON each.r = covered.r AND each.i = covered.i GROUP BY each.r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
""",
    "op5_line_dedup": r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, greatest(len(lines) - 2, 0))) AS pos, lines FROM d WHERE doc_id IS NOT NULL AND text IS NOT NULL
), k AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY lines[pos + 1], lines[pos + 2], lines[pos + 3] ORDER BY doc_id, pos) AS n FROM w
), covered AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM k WHERE n > 1
), l AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM d
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text,
    count(*) AS n_lines, count(c.pos) AS n_removed
  FROM l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END AS text,
  coalesce(kept.n_lines, 0) AS n_lines, coalesce(kept.n_removed, 0) AS n_removed
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), reach AS (
  SELECT a AS doc_id, b AS other FROM l
  UNION
  SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other
), c AS (
  SELECT w.doc_id, least(w.doc_id, min(other)) AS component_id FROM w LEFT JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
FROM d
WINDOW best AS (PARTITION BY norm ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
    "op11_spelling": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, x)) AS steps
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), each AS MATERIALIZED (
  SELECT id, run, count(*) AS n FROM runs GROUP BY id, run
), summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)),
    lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1]), 4294967295)) AS h
  FROM each, crc
), w AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), cut AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, CAST(unnest(range(length(word))) AS INT) AS i FROM w)
), near AS (
  SELECT cut.word, w.word AS other FROM cut JOIN w ON cut.rest = w.word
  UNION
  SELECT w.word, cut.word FROM cut JOIN w ON cut.rest = w.word
  UNION
  SELECT a.word, b.word FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
), best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS other, max(w.n) AS other_n FROM near JOIN w ON w.word = near.other GROUP BY near.word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word
), follow AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT follow.word, formed.form FROM follow JOIN formed ON formed.word = follow.root WHERE formed.form IS NOT NULL
), ends AS (
  SELECT follow.word, follow.root FROM follow JOIN formed ON formed.word = follow.root WHERE formed.form IS NULL
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends ON ends.word = formed.word
""",
    "op12_divergence": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS MATERIALIZED (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(*) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), g AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), c AS MATERIALIZED (
  SELECT t.lang, t.source, t.term, CAST(sum(t.n) AS HUGEINT) AS n FROM t SEMI JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS p, 1 + 1000000000 * (k.n + 1) // (v.total + v.v) AS usual
  FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - usual) * (p - usual) // usual AS BIGINT) FROM p WHERE n > 0 AND p > usual
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM all_parts
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
""",
    "op13_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), reach AS (
  SELECT a AS doc_id, b AS other FROM l
  UNION
  SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other
), c AS (
  SELECT w.doc_id, least(w.doc_id, min(other)) AS component_id FROM w LEFT JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
""",
}
