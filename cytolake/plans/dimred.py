"""Dimension reduction: change points of methylation, merged over samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytolake.config import MergeType
from cytolake.functions.aggregates import over_rows
from cytolake.functions.algorithms import Cost, binomial_cost, dbscan, pelt
from cytolake.operators.intervals import breakpoints, resampled
from cytolake.operators.ranges import WIDTH, by_groups, distance_parts, overlapping_chunks, previous, running
from cytolake.operators.replicates import merged
from cytolake.operators.sites import context_is, coverage_gt


def nan_mean(values: np.ndarray) -> float:
    """The mean of the known values; NaN without any."""
    known = values[~np.isnan(values)]
    return float(known.mean()) if len(known) else float("nan")


def change_points(sites: DataFrame, beta: float | None = None, min_size: int = 20, chunk: int = 10_000, overlap: int = 1_000, width: int = WIDTH, cost: Cost = binomial_cost, data: tuple[str, ...] = ("count_m", "count_total")) -> DataFrame:
    """(chr, position, density): ends of segments with their mean density. A task holds one chunk of sites at a time.

    cost gives each candidate's cost from the sums of the columns data over it (numpy arrays)."""

    def run(rows: dict[str, np.ndarray]) -> list[tuple]:
        cuts, _ = pelt(*[rows[c] for c in data[:2]], beta, min_size, cost=cost, more=tuple(rows[c] for c in data[2:]))
        at, d = rows["position"], rows["density"]
        edges = [0, *cuts, len(at)]
        out = [(rows["chr"][0], int(at[e]) if e < len(at) else int(at[-1]), nan_mean(d[s:e])) for s, e in zip(edges, edges[1:], strict=False)]
        return out if rows["final"][0] else out[:-1]

    rows = overlapping_chunks(sites, chunk, overlap, width).select("chr", "chunk", "position", "density", "final", *[c for c in data if c not in ("position", "density")])
    return by_groups(rows, ("chr", "chunk"), "position", run, StructType().add("chr", "string").add("position", "long").add("density", "double"))


def segmented(sites: DataFrame, beta: float | None = None, min_size: int = 20, chunk: int = 10_000, overlap: int = 1_000, width: int = WIDTH) -> DataFrame:
    """Sites with segment, the number of the stretch between change points that they belong to (from 0). A change point
    is the first row of a segment; segments of neighbouring chunks are cut at the points of either."""
    points = change_points(sites, beta, min_size, chunk, overlap, width).select("chr", "position").distinct()
    last = sites.groupBy("chr").agg(F.max("position").alias("_last"))
    # the chromosome's last position ends the last segment, and begins none
    begins = points.join(last, "chr").filter("position < _last").select("chr", "position", F.lit(1).cast("long").alias("_new"))
    rows = sites.join(begins, ["chr", "position"], "left")
    return running(rows, {"segment": F.coalesce("_new", F.lit(0))}, width=width).drop("_new")


def stitched(points: DataFrame, joint: int = 5, width: int = WIDTH) -> DataFrame:
    """Change points at most joint apart become one: the last position, the mean density."""
    one = points.groupBy("chr", "position").agg(F.sum("density").alias("density"), F.count("density").alias("n"))
    parts = distance_parts(one, joint, width=width)
    return parts.groupBy("chr", "part").agg(F.max("position").alias("position"), (F.sum("density") / F.sum("n")).alias("density")).drop("part")


def shrink(samples: DataFrame, context: str = "CG", coverage: int = 5, beta: float | None = None, min_size: int = 20, chunk: int = 10_000, overlap: int = 1_000, joint: int = 5, width: int = WIDTH) -> DataFrame:
    """(chr, start, end, value): the step function between stitched change points."""
    sites = merged(samples, "sum", "mean").filter(coverage_gt(coverage)).filter(context_is(context))
    points = stitched(change_points(sites, beta, min_size, chunk, overlap, width), joint, width)
    return previous(points, "_before", width=width).select("chr", F.coalesce("_before", F.lit(0)).cast("long").alias("start"), F.col("position").alias("end"), F.col("density").alias("value"))


def merged_breakpoints(intervals: DataFrame, how: MergeType, width: int = WIDTH) -> DataFrame:
    """(chr, position) of all samples' intervals: the distinct ones, or one for each cluster of near ones."""
    points = breakpoints(intervals)
    if how.kind == "full":
        return points.distinct()
    one = points.groupBy("chr", "position").agg(F.count("*").alias("n"))
    parts = distance_parts(one, how.max_dist, width=width)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        rows = rows.loc[rows.index.repeat(rows["n"])]
        return pd.DataFrame({"chr": key[0], "part": key[1], "cluster": dbscan(rows["position"].to_numpy(), how.eps, how.min_points), "position": rows["position"].to_numpy()})

    clusters = parts.groupBy("chr", "part").applyInPandas(run, "chr string, part long, cluster long, position long").filter("cluster >= 0")
    return clusters.groupBy("chr", "part", "cluster").agg(F.round(over_rows(how.agg, F.col("position").cast("double"))).cast("long").alias("position")).select("chr", "position").distinct()


def merge(intervals: DataFrame, how: MergeType = MergeType(), width: int = WIDTH) -> DataFrame:  # noqa: B008
    """(sample, chr, start, end, value): every sample's step function on the common breakpoints. intervals has a sample
    column; a sample without a chromosome has no rows there."""
    points = merged_breakpoints(intervals, how, width)
    bins = previous(points, "start", width=width).select("chr", "start", F.col("position").alias("end")).filter("start is not null")
    # the sample takes part in the key: chromosomes of different samples never meet
    key = F.concat_ws("\x01", "sample", "chr")
    mine = intervals.select("sample", "chr").distinct()
    out = resampled(intervals.select(key.alias("chr"), "start", "end", "value"), mine.join(bins, "chr").select(key.alias("chr"), "start", "end"))
    return out.select(F.split("chr", "\x01")[0].alias("sample"), F.split("chr", "\x01")[1].alias("chr"), "start", "end", "value")


def summary(sites: DataFrame, points: DataFrame) -> DataFrame:
    """(cytosines, changepoints, ratio in percent)."""
    n, m = sites.agg(F.count("*").alias("cytosines")), points.agg(F.count("*").alias("changepoints"))
    return n.join(F.broadcast(m)).withColumn("ratio", F.when(F.col("cytosines") > 0, 100.0 * F.col("changepoints") / F.when(F.col("cytosines") > 0, F.col("cytosines"))).otherwise(0.0))
