"""Differentially methylated regions: one lazy plan from samples to filtered rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytolake.functions.algorithms import segment_differences
from cytolake.operators.pvalues import adjusted
from cytolake.operators.ranges import WIDTH, by_groups, gap_segments
from cytolake.operators.replicates import paired
from cytolake.sources.shared import scratch


@dataclass(frozen=True)
class Options:
    context: str = "CG"
    n_missing: int = 0
    min_coverage: int = 5
    min_cytosines: int = 10
    diff_threshold: float = 0.05
    max_dist: int = 100
    initial_l: float = 2.0
    l_min: float = 1e-3
    coef: float = 1.5
    tolerance: float = 1e-6
    merge_p: float = 0.01
    padj: float = 0.05
    method: str = "bh"


ROWS = StructType().add("chr", "string").add("start", "long").add("end", "long").add("n_cytosines", "long").add("p_value", "double").add("meth_a", "double").add("meth_b", "double")


def segments(pairs: DataFrame, o: Options = Options(), width: int = WIDTH) -> DataFrame:  # noqa: B008
    """(chr, start, end, n_cytosines, p_value, meth_a, meth_b, meth_diff, meth_mean) of pairs (chr, position, density_a,
    density_b). A task handles one stretch of sites without a gap of max_dist at a time; rows of a single position go."""

    def run(rows: dict[str, np.ndarray]) -> list[tuple]:
        a, b, at = rows["density_a"], rows["density_b"], rows["position"]
        if len(at) == 1:  # a row of a single position: it would go below
            return []
        found = segment_differences(a, b, o.initial_l, o.l_min, o.coef, o.diff_threshold, o.min_cytosines, o.tolerance, o.merge_p)
        return [(rows["chr"][0], int(at[s]), int(at[e - 1]), e - s, p, float(np.mean(a[s:e])), float(np.mean(b[s:e]))) for s, e, p in found if e - s > 1]

    cut = gap_segments(pairs, o.max_dist, width=width).select("chr", "segment", "position", "density_a", "density_b")
    found = by_groups(cut, ("chr", "segment"), "position", run, ROWS)
    return found.withColumn("meth_diff", F.col("meth_a") - F.col("meth_b")).withColumn("meth_mean", (F.col("meth_a") + F.col("meth_b")) / 2)


def kept(found: DataFrame) -> DataFrame:
    """The rows in a table of the shared folder."""
    spark = found.sparkSession
    path = scratch(spark, "segments")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def filtered(found: DataFrame, o: Options = Options()) -> DataFrame:  # noqa: B008
    """Segments with adjusted p-values that pass all thresholds. The segments are stored first: they are read twice,
    and dear to make."""
    rows = adjusted(kept(found), "p_value", o.method)
    return rows.filter((F.col("padj") <= o.padj) & (F.abs("meth_diff") >= o.diff_threshold) & (F.col("n_cytosines") >= o.min_cytosines))


def regions(samples: DataFrame, in_a: Column, in_b: Column, n_a: int, n_b: int, o: Options = Options(), width: int = WIDTH) -> DataFrame:  # noqa: B008
    """Segments of the samples of two groups."""
    return segments(paired(samples, in_a, in_b, o.context, o.min_coverage, o.n_missing, n_a, n_b), o, width)


def write(found: DataFrame, prefix: str, o: Options = Options()) -> None:  # noqa: B008
    """<prefix>.segments.tsv and <prefix>.filtered.tsv, in order; p-values in scientific notation."""
    from cytolake.sources.reports import scientific

    found = kept(found)
    for name, rows in (("segments", found), ("filtered", filtered(found, o))):
        rows = rows.orderBy("chr", "start").withColumns({c: scientific(F.col(c)) for c in ("p_value", "padj") if c in rows.columns})
        rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{prefix}.{name}.tsv")
