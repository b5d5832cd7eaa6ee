"""Methylation statistics, mergeable as partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.scalar import context_name, density, strand_symbol


def site_density() -> Column:
    """From the counts where there are any, else the given density."""
    return F.when(F.col("count_total") > 0, F.col("count_m") / F.when(F.col("count_total") > 0, F.col("count_total"))).otherwise(F.col("density"))


def _real() -> Column:
    d = site_density()
    return F.when(~F.isnan(d), d)


def region_stats(sites: DataFrame) -> DataFrame:
    """(kind, label, sum_density, n, mean) per context and per strand, in one pass over grouping sets."""
    rows = sites.select(context_name(F.col("context")).alias("c"), strand_symbol(F.col("strand")).alias("s"), _real().alias("d"))
    # two labels of each row rather than two scans
    labels = rows.select(F.explode(F.array(F.struct(F.lit("context").alias("kind"), F.col("c").alias("label")), F.struct(F.lit("strand").alias("kind"), F.col("s").alias("label")))).alias("l"), "d")
    return finalized(labels.groupBy("l.kind", "l.label").agg(F.sum("d").alias("sum_density"), F.count("d").alias("n")))


def grouping_sets(sites: DataFrame, keys: str = "chr") -> DataFrame:
    """(key, context, strand, n_sites, sum_m, sum_total, mean_density) over grouping sets: by key and context, by key
    and strand, and over all."""
    named = sites.select(keys, context_name(F.col("context")).alias("context"), strand_symbol(F.col("strand")).alias("strand"), "count_m", "count_total", _real().alias("d"))
    sets = [[F.col(keys), F.col("context")], [F.col(keys), F.col("strand")], []]
    return named.groupingSets(sets, keys, "context", "strand").agg(F.count("*").alias("n_sites"), F.sum("count_m").alias("sum_m"), F.sum("count_total").alias("sum_total"), F.avg("d").alias("mean_density"))


def partials(sites: DataFrame, *keys: str) -> DataFrame:
    """Sums that merge by addition."""
    return sites.groupBy(*keys).agg(F.sum(_real()).alias("sum_density"), F.count(_real()).alias("n"))


def merged_partials(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("sum_density").alias("sum_density"), F.sum("n").alias("n"))


def finalized(parts: DataFrame) -> DataFrame:
    return parts.withColumn("mean", density(F.col("sum_density"), F.col("n")))


def coverage_histogram(sites: DataFrame) -> DataFrame:
    """(count_total, n); sites without reads count at 0."""
    return sites.groupBy(F.coalesce("count_total", F.lit(0)).cast("long").alias("count_total")).agg(F.count("*").alias("n"))
