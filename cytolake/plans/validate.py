"""Consistency of several files' tables: batches, extents, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.operators.ordering import majority
from cytolake.operators.sites import extents


def summaries(samples: DataFrame, deep: bool = False) -> DataFrame:
    """(sample, chr, batch, contig, n_sites[, digest]) of every batch; digest stands for its positions:
    two sums of independent 64-bit hashes, so that different sets agree with a chance of 2**-128."""
    keys = ["sample", "chr", "batch"]
    rows = samples.groupBy(*keys).agg(F.min("position").alias("start"), F.max("position").alias("end"), F.count("*").alias("n_sites"), *([F.concat_ws(":", *[F.sum(F.xxhash64(F.lit(seed), "position").cast("decimal(20,0)")).cast("string") for seed in (1, 2)]).alias("digest")] if deep else []))
    return rows.withColumn("contig", F.format_string("%s:%d-%d (.)", "chr", "start", "end"))


def disagreements(samples: DataFrame, deep: bool = False) -> DataFrame:
    """(chr, batch, n_samples, n_contigs, n_sizes, n_digests) of batches in which the samples differ."""
    s = summaries(samples, deep)
    n = samples.select("sample").distinct().agg(F.count("*").alias("_all"))
    found = s.groupBy("chr", "batch").agg(F.count("*").alias("n_samples"), F.count_distinct("contig").alias("n_contigs"), F.count_distinct("n_sites").alias("n_sizes"), (F.count_distinct("digest") if deep else F.lit(1).cast("long")).alias("n_digests"))
    return found.join(F.broadcast(n)).filter("n_samples <> _all or n_contigs > 1 or n_sizes > 1 or n_digests > 1").drop("_all")


def block_counts(samples: DataFrame) -> DataFrame:
    """(n_blocks, n, members, majority): which samples have how many batches."""
    blocks = samples.select("sample", "chr", "batch").distinct().groupBy("sample").agg(F.count("*").alias("n_blocks"))
    return majority(blocks, "n_blocks", "sample")


def validate(samples: DataFrame, deep: bool = False) -> list[str]:
    """Findings in words, all of them, a batch at a time; an empty list means that the samples agree."""
    counts = block_counts(samples).collect()  # a row per distinct count
    out = [f"{', '.join(r['members'])}: {r['n_blocks']} batches" for r in counts if not r["majority"]]
    bad = disagreements(samples, deep)
    return out + [f"{r['chr']} batch {r['batch']}: samples {r['n_samples']}, contigs {r['n_contigs']}, sizes {r['n_sizes']}, positions {r['n_digests']}" for r in bad.orderBy("chr", "batch").toLocalIterator()]


__all__ = ["block_counts", "disagreements", "extents", "summaries", "validate"]
