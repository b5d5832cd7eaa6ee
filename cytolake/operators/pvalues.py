"""Rank tests, correlation and p-value adjustment."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytolake.config import adjustment
from cytolake.functions.algorithms import tolerance_runs
from cytolake.operators.ranges import by_groups


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """2 * Phi(-|z|); neither SQL engine has erfc."""
    return z.map(lambda x: None if x is None or x != x else min(1.0, math.erfc(abs(x) / math.sqrt(2))))


def tied(by_value: DataFrame, value: str, keys: tuple[str, ...], tolerance: float) -> DataFrame:
    """Distinct values with counts _t and _t1, those of a run (within tolerance of its first) joined under the first.

    Only values that are near their neighbour can be in a run: such stretches are read in order, one at a time."""
    w = Window.partitionBy(*keys).orderBy(value)
    near = F.coalesce(F.col(value) - F.lag(value).over(w) <= tolerance, F.lit(False))
    followed = F.coalesce(F.lead(value).over(w) - F.col(value) <= tolerance, F.lit(False))
    cut = by_value.withColumn("_near", near).withColumn("_some", near | followed)
    cut = cut.withColumn("_island", F.sum((~F.col("_near")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    few = cut.filter("_some").select(*keys, "_island", value, "_t", "_t1")
    kinds = {f.name: f.dataType for f in few.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, value, "_t", "_t1")])

    def run(rows: dict) -> list[tuple]:
        own = [rows[k][0] for k in keys]
        return [(*own, float(rows[value][lo]), int(rows["_t"][lo:hi].sum()), int(rows["_t1"][lo:hi].sum())) for lo, hi in tolerance_runs(rows[value], tolerance)]

    return cut.filter(~F.col("_some")).select(*schema.names).unionByName(by_groups(few, (*keys, "_island"), value, run, schema))


def mann_whitney(df: DataFrame, value: str, first: Column, *keys: str, tolerance: float = 1e-6) -> DataFrame:
    """(keys, n1, n2, u, z) of rows where first holds against the others; ties (values within tolerance of the first of
    their run) share their mean rank, the variance is corrected for them, 0.5 for continuity. NaN and null values are
    left out. An empty group: u 0, z 0. Keys are not null.

    Equal values are counted before anything is ranked, so a window runs over distinct values only."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_f", first.cast("long")).withColumn(value, F.col(value).cast("double"))
    by_value = rows.groupBy(*keys, value).agg(F.count("*").alias("_t"), F.sum("_f").alias("_t1"))
    by_value = tied(by_value, value, keys, tolerance) if tolerance > 0 else by_value
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("_r", F.coalesce(F.sum("_t").over(w), F.lit(0)) + (F.col("_t") + 1) / 2)
    t = F.col("_t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("_t1").alias("n1"), F.sum(F.col("_t") - F.col("_t1")).alias("n2"), F.sum(F.col("_r") * F.col("_t1")).alias("_r1"), F.sum(t * t * t - t).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, product = n1 + n2, n1 * n2
    some = product > 0
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    u = F.when(some, F.least(u1, product - u1)).otherwise(0.0)
    variance = F.when(some & (n > 1), product / 12 * ((n + 1) - F.col("_ties") / F.when(n > 1, n * (n - 1))))
    z = F.when(variance > 0, (u - product / 2 + 0.5) / F.sqrt(F.when(variance > 0, variance))).otherwise(0.0)
    return sums.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))


def mann_whitney_p(df: DataFrame, value: str, first: Column, *keys: str) -> DataFrame:
    """The same with p; 1 where a group is empty or nothing varies."""
    return mann_whitney(df, value, first, *keys).withColumn("p", two_sided("z"))


def pearson(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, r): 0 without rows or variance."""
    return df.groupBy(*keys).agg(F.corr(x, y).alias("r")).withColumn("r", F.when(F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r")))


#: Ranges of p-values that are ranked apart: so many for each halving.
RANGES = 64


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed for small n, else by its expansion, which is exact to 1e-13 from 20 on."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(20))), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)
    return F.when(n <= 20, small).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))


def adjusted(df: DataFrame, p: str = "p_value", method: str = "bh", name: str = "padj", key: str | None = None) -> DataFrame:
    """df with adjusted p-values, null for null. Equal p-values get equal results, so key (ranks of ties) is not needed.

    Distinct p-values are counted, cut into ranges by their logarithm, ranked within a range, and carried over the
    ranges, whose number is fixed: no task sorts all p-values. df is read twice: an expensive one is stored before."""
    method = adjustment(method)
    if method == "none":
        return df.withColumn(name, F.col(p))
    counted = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_c"))
    if method == "bonf":
        n = counted.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))
        return df.join(F.broadcast(n)).withColumn(name, F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")
    # 0 and below first, then 64 ranges from each power of two to the next
    counted = counted.withColumn("_range", F.when(F.col("_p") > 0, F.floor(F.log2(F.when(F.col("_p") > 0, F.col("_p"))) * RANGES)).otherwise(F.lit(-1_000_000)).cast("long"))
    order = Window.orderBy("_range")  # the ranges: at most 64 * 1100
    sums = counted.groupBy("_range").agg(F.sum("_c").alias("_s"))
    sums = sums.select("_range", F.coalesce(F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_n"))
    upto = Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    harmonic = _harmonic(F.col("_n")) if method == "by" else F.lit(1.0)
    ranked = counted.join(F.broadcast(sums), "_range").withColumn("_v", F.col("_p") * F.col("_n") / (F.sum("_c").over(upto) + F.col("_before")) * harmonic)
    down = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy("_range").agg(F.min("_v").alias("_m")).select("_range", F.min("_m").over(down).alias("_after"))
    inside = Window.partitionBy("_range").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = ranked.join(F.broadcast(least), "_range").select("_p", F.least(F.lit(1.0), F.min("_v").over(inside), F.col("_after")).alias(name))
    return df.join(found, F.col(p) == F.col("_p"), "left").drop("_p")
