"""A corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Operators delete the tables that they stored on their
way, except those that the result reads; run() writes every stage's result as Parquet in the shared folder, deletes what
the stage had stored and the result before it, and reads the new one for the next stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import byte_bpe, mixing, ngram_join, quality, suffix_dedup
from cytolake.llm._common import collected, removed, stored

#: Documents below this probability of good quality go.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, accepts. Null and empty texts are scored too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels), keep=tuple(docs.columns))
    # the columns kept come last and have the input's names; the score and the id before them may share these
    scored = scored.toDF("_id", "_score", *docs.columns)
    return scored.filter(F.col("_score") >= LEAST_QUALITY).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document, of the smallest id (null ids last). Documents without words link
    with nothing and all stay."""
    found = ngram_join.join(docs, keep=tuple(docs.columns)).toDF("_id", "_n", "_component", "_chosen", *docs.columns)
    return found.filter("_chosen").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier, cut at whole characters; n_chars follows. Texts of
    which nothing is left go; null and empty texts, of which nothing was removed, stay."""
    cut = suffix_dedup.dedup(docs, characters=True, keep=tuple(docs.columns))
    cut = cut.toDF("_id", "_bytes", "_removed", "_spans", "_kept", "_where", *docs.columns)
    text = F.when(F.col("text").isNotNull(), F.decode("_kept", "UTF-8"))
    out = cut.filter((F.col("_removed") == 0) | (F.length("_kept") > 0)).withColumn("_text", text)
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.when(F.col("_removed") > 0, F.length("_text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: documents repeated or cut as the mix takes them."""
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (tokens) and n_tokens of each document of the mix."""
    tokens = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("mixing sources", mixed),
    ("byte-level BPE", encoded),
]

#: The classifier has no SQL: tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. The result's table goes when the application ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        with collected() as tables:
            result = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        removed(spark, [*before, *tables[:-1]])
        docs, before = result, tables[-1:]
    return docs
