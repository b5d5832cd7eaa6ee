"""Order of chromosomes, and majority reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chr_order(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, k) for k, n in enumerate(names)], "chr string, ord long")


def regions_sorted(regions: DataFrame, order: DataFrame) -> DataFrame:
    """By (chromosome order, start); unknown chromosomes count as the first."""
    return regions.join(order, "chr", "left").orderBy(F.coalesce("ord", F.lit(0)), "start").drop("ord")


def sites_sorted(sites: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """By chromosome and position; a given order also leaves out all other chromosomes. Without one, by name."""
    if order is None:
        return sites.orderBy("chr", "position")
    return sites.join(order, "chr").orderBy("ord", "position").drop("ord")


def majority(df: DataFrame, value: str, member: str) -> DataFrame:
    """(value, n, members, majority): who has which value; the most frequent one is marked (ties: the smallest)."""
    groups = df.groupBy(value).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    best = groups.agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), value)).alias("_best"))
    return groups.join(best).withColumn("majority", F.col(value).eqNullSafe(F.col("_best"))).drop("_best")
