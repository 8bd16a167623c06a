"""Registered queries of the operators and of the pipeline, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import (
    dart_minhash, decontamination, disclosure, document_fingerprints, language_id, mixture, prefix_trie, secret_scan,
    source_divergence, text_blocks, token_store, top_k, toxicity,
)
from trailmark.llm.shared import fold_column, read


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: doc_id, class_id, class_size."""
    return dart_minhash.near_duplicate_classes(read(spark, sf_dir, "documents"))


def op2_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, n_kept, n_blocks."""
    return text_blocks.extract(read(spark, sf_dir, "pages"))


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed personal data and disclosing terms of every document."""
    return disclosure.span_report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids as read back from the token files."""
    return token_store.token_file_digests(spark, read(spark, sf_dir, "documents"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a document in the mix: doc_id, leaf, epoch, n_tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixture.mixed(docs, more=True).select("doc_id", "domain", "language", "leaf_source", "epoch", "n_tokens")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the folds other than 0."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(language_id.train_part(docs, 5))
    return language_id.predict(docs, model).select(
        "doc_id", (fold_column(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labelled folds other than 2."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.train_part(docs, read(spark, sf_dir, "labels"), 4, 2))
    return toxicity.toxic_scores(docs, model).select(
        "doc_id", (fold_column(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted"
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed and random-looking secrets of every document."""
    return secret_scan.secret_report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document: doc_id, item_id, edits, start, end."""
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best neighbours of every hundredth vector."""
    return top_k.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlikeness of every two sources of a language, and the terms that each source overuses."""
    return source_divergence.divergence(read(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise fingerprint of every document and of its edited text, with their likeness."""
    return document_fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_dart_minhash, op2_text_blocks, op3_disclosure, op4_token_store, op5_mixture, op6_language_id, op7_toxicity,
        op8_secret_scan, op9_decontamination, op10_top_k, op11_source_divergence, op12_document_fingerprints,
        op13_prefix_trie, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op10_top_k": """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op11_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM found GROUP BY lang, source, term
), grps AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM grps g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM dense
), langs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM kept
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, CAST((s.p - l.q) * (s.p - l.q) // (s.p + l.q) AS BIGINT)
  FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term
  WHERE s.n > 0 AND s.p > l.q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM items
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op13_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'digest': digest, 'words': words} ORDER BY turn NULLS FIRST, digest) AS turns,
         -- crc32 of the decimal id, bit by bit
         xor(4294967295, list_reduce(
           list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
           lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
             lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)),
           4294967295)) % 4 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, o.h), list_slice(o.turns, o.h + 1, len(o.turns))) AS seq
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(seq) AS n, depth, list_transform(list_slice(seq, 1, depth), lambda x: x.digest) AS path,
         CASE WHEN depth > 0 THEN seq[depth].words ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY path
), children AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), above AS (
  SELECT list_slice(path, 1, a) AS path, n_convs, words, n_children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM counted)
), sums AS (
  SELECT path, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)
""",
}
