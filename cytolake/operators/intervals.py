"""Joins of intervals with points and with each other, on bins of positions.

The equality of (chr, bin) makes a hash or merge join; the bounds are its residual condition. Regions are copied to the
bins that they touch, sites are not. A pair of intervals meets in several bins and counts in the first they share, so
no distinct follows. Spark broadcasts a side that is small by its statistics; otherwise both are shuffled by bin, which
spreads a long chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions.scalar import nan
from cytolake.operators.ranges import WIDTH, previous

BIN = 1 << 14


def _bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width)
    return df.withColumn("_first", first.cast("long")).withColumn("_bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def in_regions(sites: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Each site with each region (chr, start, end, ...) that holds it: start <= position < end."""
    s = sites.withColumn("_bin", F.floor(F.col("position") / width).cast("long")).alias("s")
    r = _bins(regions, "start", "end", width).alias("r")
    rows = s.join(r, (F.col("s.chr") == F.col("r.chr")) & (F.col("s._bin") == F.col("r._bin")) & (F.col("position") >= F.col("r.start")) & (F.col("position") < F.col("r.end")))
    return rows.select(*[F.col(f"s.{c}") for c in sites.columns], *[F.col(f"r.{c}") for c in regions.columns if c not in sites.columns])


def query(sites: DataFrame, chr: str, start: int, end: int, strict: bool = False) -> DataFrame:  # noqa: A002
    """Sites of one region: a filter that reaches the Parquet scan. strict: an unknown chromosome is an error."""
    if strict and sites.filter(F.col("chr") == chr).isEmpty():
        raise ValueError(f"unknown chromosome {chr!r}")
    return sites.filter((F.col("chr") == chr) & (F.col("position") >= start) & (F.col("position") < end))


def overlapping(a: DataFrame, b: DataFrame, width: int = BIN, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Pairs of overlapping intervals (chr, start, end, ...) of two tables; columns but chr get the suffixes."""
    x, y = _bins(a, "start", "end", width).alias("x"), _bins(b, "start", "end", width).alias("y")
    on = (F.col("x.chr") == F.col("y.chr")) & (F.col("x._bin") == F.col("y._bin")) & (F.col("x.start") < F.col("y.end")) & (F.col("x.end") > F.col("y.start"))
    rows = x.join(y, on & (F.col("x._bin") == F.greatest("x._first", "y._first")))
    named = [F.col(f"{t}.{c}").alias(f"{c}{s}") for t, d, s in (("x", a, suffixes[0]), ("y", b, suffixes[1])) for c in d.columns if c != "chr"]
    return rows.select(F.col("x.chr").alias("chr"), *named)


def known_chromosomes(df: DataFrame, known: DataFrame) -> DataFrame:
    return df.join(known.select("chr").distinct(), "chr", "left_semi")


def breakpoints(intervals: DataFrame) -> DataFrame:
    """(chr, position): every start and end, repeats kept."""
    return intervals.select("chr", F.explode(F.array("start", "end")).alias("position"))


def from_breakpoints(points: DataFrame, reference: bool = False, width: int = WIDTH) -> DataFrame:
    """(chr, start, end) between consecutive breakpoints, from 0; with reference every interval starts at 0."""
    rows = points.withColumn("_before", F.lit(0)) if reference else previous(points, "_before", width=width)
    return rows.select("chr", F.coalesce("_before", F.lit(0)).cast("long").alias("start"), F.col("position").alias("end"))


def counts(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.count("*").alias("n_intervals"), F.count_distinct("chr").alias("n_chr"))


def resampled(values: DataFrame, bins: DataFrame, width: int = BIN) -> DataFrame:
    """(chr, start, end, value): for each bin the mean of a step function (chr, start, end, value), weighted with the
    overlap; NaN for bins without overlap."""
    pairs = overlapping(bins.select("chr", "start", "end"), values.select("chr", "start", "end", "value"), width)
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b")
    means = pairs.groupBy("chr", F.col("start_a").alias("start"), F.col("end_a").alias("end")).agg((F.sum(F.col("value_b") * shared) / F.sum(shared)).alias("value"))
    return bins.select("chr", "start", "end").join(means, ["chr", "start", "end"], "left").withColumn("value", F.coalesce("value", nan()))
