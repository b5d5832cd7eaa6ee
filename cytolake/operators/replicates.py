"""Replicate samples: merged by site, never by row number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.aggregates import Aggregate, over_rows

KEY = ("chr", "position", "strand", "context")


def sampled(samples: dict[str, DataFrame]) -> DataFrame:
    """One table with a sample column. No samples is an error."""
    if not samples:
        raise ValueError("no samples")
    return reduce(DataFrame.unionByName, [s.withColumn("sample", F.lit(name)) for name, s in samples.items()])


def merged(samples: DataFrame, counts: Aggregate = "sum", density: Aggregate = "mean") -> DataFrame:
    """One row per site: both counts by one aggregate, the density by another. Groups treat null strand and context as
    values; one sample gives its own values back. Counts are cut to whole numbers."""
    rows = samples.groupBy(*KEY)
    count = lambda c: over_rows(counts, F.col(c).cast("double")).cast("long").alias(c)
    return rows.agg(count("count_m"), count("count_total"), over_rows(density, F.col("density")).alias("density"))


def missing(samples: DataFrame, n_samples: int) -> DataFrame:
    """(chr, position, n_missing): samples that do not know a site's density, or have no row for it."""
    known = F.count_distinct(F.when(F.col("density").isNotNull(), F.col("sample")))
    return samples.groupBy("chr", "position").agg((F.lit(n_samples) - known).cast("long").alias("n_missing"))


def paired(samples: DataFrame, in_a: Column, in_b: Column, context: str | None = None, min_coverage: int = 0, n_missing: int | None = None, n_a: int = 0, n_b: int = 0) -> DataFrame:
    """(chr, position, density_a, density_b): sites that both groups cover, from one aggregation.

    Counts are summed and densities averaged within a group; a group counts where its reads are over min_coverage and
    at most n_missing of its samples lack the site."""
    rows = samples if context is None else samples.filter({"CG": F.col("context"), "CHG": ~F.col("context"), "CHH": F.col("context").isNull()}[context.upper()])
    out = []
    for name, test in (("a", in_a), ("b", in_b)):
        out += [F.sum(F.when(test, F.col("count_total"))).alias(f"total_{name}"), F.avg(F.when(test & ~F.isnan("density"), F.col("density"))).alias(f"density_{name}"), F.count_distinct(F.when(test & F.col("density").isNotNull(), F.col("sample"))).alias(f"known_{name}")]
    both = rows.groupBy("chr", "position").agg(*out)
    tests = [F.col(f"total_{g}") > min_coverage for g in "ab"] + [F.col(f"density_{g}").isNotNull() for g in "ab"]
    if n_missing is not None:
        tests += [F.lit(n) - F.col(f"known_{g}") <= n_missing for g, n in (("a", n_a), ("b", n_b))]
    return reduce(DataFrame.filter, tests, both).select("chr", "position", "density_a", "density_b")
