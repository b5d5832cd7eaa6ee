"""The corpus operators as named queries over the driver's tables, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import byte_bpe, kneser_ney, mixing, mtree, ngram_join, prefix_forest, quality, substring_dedup, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source")


SQL["op3_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS shuffle
  FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), placed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM sizes
), filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM placed
), targets AS (SELECT source, source_size, greatest(0.0, least(cap, weight * max((budget - before) / rest) OVER ())) AS target FROM filled
), queued AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
    (sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS ahead
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), passes AS (SELECT *, ahead + turn * source_size AS start FROM queued, (VALUES (0), (1)) p(turn)
), halves AS (SELECT *, greatest(0, least(size, quota - start)) AS early FROM passes
), packets AS (
  SELECT doc_id, source, shuffle, start AS first, early AS words, (start + early) / target AS finish FROM halves WHERE target > 0
  UNION ALL SELECT doc_id, source, shuffle, start + early, size - early, (start + size) / target FROM halves WHERE target > 0
), served AS (
  SELECT *, sum(words) OVER (ORDER BY finish, shuffle, first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM packets WHERE words > 0
), taken AS (
  SELECT doc_id, sum(greatest(0, least(words, words - (upto - (SELECT floor(1.5 * sum(size)) FROM d))))) AS taken FROM served GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, source FROM queued LEFT JOIN taken USING (doc_id)
"""


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that lie in a 13-word window of an earlier document go."""
    cut = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op4_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM windows JOIN firsts USING (s) WHERE first < doc_id
), words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that lie in a 100-byte string that starts earlier go."""
    cut = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op7_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS s
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)
), firsts AS (SELECT s, min((doc_id, i)) AS first FROM windows GROUP BY s
), late AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE (doc_id, i) > first
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM late))
  GROUP BY doc_id, run
), spans AS (
  SELECT doc_id, count(*) AS n, sum(b - a) AS gone, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY doc_id
)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(1, n + 2), lambda k:
    substr(x, 2 * coalesce(ends[k - 1], 0) + 1, 2 * (coalesce(starts[k], length(x) // 2) - coalesce(ends[k - 1], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id)
"""


@_query
def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one, approximately."""
    return prefix_forest.neighbours(_table(spark, sf_dir, "embeddings"))


@_query
def op6_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector."""
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


SQL["op6_mtree_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


@_query
def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are over 2048."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of the ids and of the bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels outside the held-out fifth."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out("doc_id", 5, 0)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL["op8_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1
), overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM (SELECT * FROM shingles SEMI JOIN shared USING (s)) a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a
), component AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN component USING (doc_id)
"""


@_query
def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a bigram model and under unigrams, learned from six sevenths."""
    held_out = quality.held_out("doc_id", 7, 2)
    scored = kneser_ney.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
