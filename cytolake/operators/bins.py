"""Sites in parts: by row numbers, by equal lengths of genome, by change points; and lines to plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions.aggregates import Aggregate, over_rows
from cytolake.functions.scalar import nan
from cytolake.operators.intervals import in_regions
from cytolake.operators.ranges import WIDTH, ordinal


def partition(sites: DataFrame, breakpoints: list[int], agg: Aggregate = "mean", width: int = WIDTH) -> DataFrame:
    """(chr, part, rel_end, n, value): rows between sorted row numbers. rel_end is the place of the part's end in the
    chromosome's extent, 1 for the last part. Breakpoints lie between 1 and the number of rows."""
    if not breakpoints:
        return sites.select("chr", F.lit(0).cast("long").alias("part"), F.lit(1.0).alias("rel_end"), F.lit(0).cast("long").alias("n"), nan().alias("value")).limit(0)
    if sorted(breakpoints) != list(breakpoints) or breakpoints[0] < 1:
        raise ValueError("breakpoints ascend from 1")
    inner = breakpoints
    rows = ordinal(sites, "_o", width=width)
    part = sum((F.when(F.col("_o") >= b, 1).otherwise(0) for b in inner), F.lit(0)).cast("long")
    extent = rows.groupBy("chr").agg(F.min("position").alias("_first"), F.max("position").alias("_last"))
    parts = rows.withColumn("part", part).groupBy("chr", "part").agg(F.min("position").alias("_start"), F.count("*").alias("n"), over_rows(agg, F.col("density")).alias("value"))
    ends = parts.select("chr", (F.col("part") - 1).alias("part"), F.col("_start").alias("_next"))
    length = F.col("_last") + 1 - F.col("_first")
    out = parts.join(ends, ["chr", "part"], "left").join(extent, "chr")
    return out.select("chr", "part", F.coalesce((F.col("_next") - F.col("_first")) / length, F.lit(1.0)).alias("rel_end"), "n", "value")


def discretised(sites: DataFrame, n: int, agg: Aggregate = "mean") -> DataFrame:
    """(chr, bin, rel_end, n, value): n bins of equal length per chromosome; bin i starts at the first site at or
    after round(first + i * length / n). Empty bins have no sites and NaN. rel_end is where the next bin's first site
    lies, 1 for the last; bins that are empty to the end have 1."""
    if n < 1:
        raise ValueError("at least one bin")
    extent = sites.groupBy("chr").agg(F.min("position").alias("_first"), F.max("position").alias("_last"))
    length = F.col("_last") + 1 - F.col("_first")
    rows = sites.join(extent, "chr")
    target = lambda i: F.round(F.col("_first") + i * length / n)
    # the last target at or below the position by arithmetic, corrected by one for rounding: no list per row
    guess = F.least(F.ceil((F.col("position") - F.col("_first") + 0.5) * n / length).cast("long") - 1, F.lit(n - 1))
    up = (guess < n - 1) & (F.col("position") >= target(guess + 1))
    down = (guess > 0) & (F.col("position") < target(guess))
    rows = rows.withColumn("bin", guess + F.when(up, 1).otherwise(0) - F.when(down, 1).otherwise(0))
    found = rows.groupBy("chr", "bin").agg(F.min("position").alias("_start"), F.count("*").alias("n"), over_rows(agg, F.col("density")).alias("value"))
    spine = extent.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    out = spine.join(found, ["chr", "bin"], "left")
    starts = found.groupBy("chr").agg(F.map_from_entries(F.collect_list(F.struct("bin", "_start"))).alias("_starts"))  # at most n entries
    nexts = F.filter(F.transform(F.map_entries("_starts"), lambda e: F.when(e["key"] > F.col("bin"), e["value"])), lambda x: x.isNotNull())
    out = out.join(starts, "chr").withColumn("_next", F.array_min(nexts))
    return out.select("chr", "bin", F.coalesce((F.col("_next") - F.col("_first")) / length, F.lit(1.0)).alias("rel_end"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("value", nan()).alias("value"))


def region_lines(regions: DataFrame, sites: DataFrame) -> DataFrame:
    """(region_id, positions, densities): regions joined with their sites, positions scaled to [0, 1]. A line holds all
    sites of its region: as many as positions in it."""
    rel = (F.col("position") - F.col("start")) / (F.col("end") - F.col("start"))
    rows = in_regions(sites, regions)
    pairs = F.array_sort(F.collect_list(F.struct(rel.alias("x"), F.col("density").alias("y"))))
    return rows.groupBy("region_id").agg(pairs.alias("p")).select("region_id", F.transform("p", lambda e: e["x"]).alias("positions"), F.transform("p", lambda e: e["y"]).alias("densities"))


def line_plot(points: DataFrame, n: int, agg: Aggregate = "mean") -> DataFrame:
    """(bin, n_points, x, y) from points (x in [0, 1], y): bin = number of the edges 0, 1/(n-1), ..., 1 that are at
    most x; x averaged, y aggregated. Bins without points have NaN."""
    step = 1.0 / (n - 1)
    guess = F.floor(F.col("x") / step).cast("long")
    edge = lambda k: k * step
    b = guess + 1 + F.when(edge(guess + 1) <= F.col("x"), 1).otherwise(0) - F.when(edge(guess) > F.col("x"), 1).otherwise(0)
    found = points.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n_points"), F.avg("x").alias("x"), over_rows(agg, F.col("y")).alias("y"))
    spine = points.sparkSession.range(0, n + 1).select(F.col("id").alias("bin"))
    return spine.join(found, "bin", "left").select("bin", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("x", nan()).alias("x"), F.coalesce("y", nan()).alias("y"))


def invalid_lines(lines: DataFrame) -> DataFrame:
    """Lines whose arrays differ in length, are not ascending or leave [0, 1]."""
    p, d = F.col("positions"), F.col("densities")
    inside = lambda a: F.forall(a, lambda x: F.isnan(x) | x.between(0.0, 1.0))
    return lines.filter((F.size(p) != F.size(d)) | (F.array_sort(p) != p) | ~inside(p) | ~inside(d))


def point_counts(lines: DataFrame) -> DataFrame:
    """(n_lines, n_points, mean_points)."""
    size = F.size("positions")
    return lines.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_points"), F.avg(size).alias("mean_points"))


def shrunken(segments: DataFrame, agg: Aggregate = "mean") -> DataFrame:
    """(chr, segment, start, end, n, value) for sites that carry the segment of a change-point search (see
    plans.dimred.segmented)."""
    return segments.groupBy("chr", "segment").agg(F.min("position").alias("start"), F.max("position").alias("end"), F.count("*").alias("n"), over_rows(agg, F.col("density")).alias("value"))


def interval_mean(intervals: DataFrame) -> DataFrame:
    """(chr, mean): each interval's value weighted with its length."""
    size = F.col("end") - F.col("start")
    return intervals.groupBy("chr").agg(F.sum(F.col("value") * size).alias("w"), F.sum(size).alias("n")).select("chr", F.when(F.col("n") > 0, F.col("w") / F.when(F.col("n") > 0, F.col("n"))).otherwise(nan()).alias("mean"))
