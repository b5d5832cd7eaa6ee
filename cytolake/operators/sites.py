"""Filters, checks and conversions of site tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions import scalar as S
from cytolake.operators.ranges import WIDTH, ordinal, previous
from cytolake.schema import SITE


def from_columns(spark, chr: str, positions, strand, context, count_m, count_total) -> DataFrame:  # noqa: A002
    """Sites of one chromosome from columns of equal length; density is computed."""
    if len({len(x) for x in (positions, strand, context, count_m, count_total)}) > 1:
        raise ValueError("columns differ in length")
    rows = [(chr, *r) for r in zip(positions, strand, context, count_m, count_total, strict=True)]
    made = spark.createDataFrame(rows, "chr string, position long, strand boolean, context boolean, count_m long, count_total long")
    return made.withColumn("density", S.density(F.col("count_m"), F.col("count_total")))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SITE)


# ---------------------------------------------------------------- predicates

def pos_lt(v: int) -> Column:
    return F.col("position") < v


def pos_gt(v: int) -> Column:
    return F.col("position") > v


def coverage_gt(v: int) -> Column:
    return F.col("count_total") > v


def strand_is(v: bool | None) -> Column:
    return F.col("strand").isNull() if v is None else F.col("strand") == v


def context_is(name: str) -> Column:
    """CG, CHG or CHH."""
    found = {"CG": F.col("context"), "CHG": ~F.col("context"), "CHH": F.col("context").isNull()}
    if name.upper() not in found:
        raise ValueError(f"unknown context {name!r}")
    return found[name.upper()]


def filtered(sites: DataFrame, *tests: Column) -> DataFrame:
    """All tests in order."""
    return reduce(DataFrame.filter, tests, sites)


def sliced(sites: DataFrame, offset: int, length: int, width: int = WIDTH) -> DataFrame:
    """Rows offset .. offset + length - 1 along each chromosome."""
    return ordinal(sites, "_o", width=width).filter((F.col("_o") >= offset) & (F.col("_o") < offset + length)).drop("_o")


def split_at(sites: DataFrame, index: int, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    rows = ordinal(sites, "_o", width=width)
    return rows.filter(F.col("_o") < index).drop("_o"), rows.filter(F.col("_o") >= index).drop("_o")


def masked(sites: DataFrame, valid: Column, columns: list[str]) -> DataFrame:
    """Null in columns where valid does not hold; chr and position cannot be null."""
    if {"chr", "position"} & set(columns):
        raise ValueError("chr and position cannot be null")
    return sites.withColumns({c: F.when(valid, F.col(c)) for c in columns})


def cast(df: DataFrame) -> DataFrame:
    """The canonical columns and types; values that do not fit are an error (ANSI casts)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SITE])


def binarized(sites: DataFrame, mean: float, pvalue: float) -> DataFrame:
    """Each site as one trial: methylated if its binomial tail is at most pvalue. No reads: counts 0, density NaN."""
    p = S.binomial_tail(F.coalesce("count_m", F.lit(0)), F.coalesce("count_total", F.lit(0)), mean)
    some = F.coalesce("count_total", F.lit(0)) > 0
    m = F.when(some & (p <= pvalue), 1).otherwise(0).cast("long")
    rows = sites.withColumns({"count_m": m, "count_total": F.when(some, 1).otherwise(0).cast("long")})
    return rows.withColumn("density", S.density(F.col("count_m"), F.col("count_total")))


# ---------------------------------------------------------------- report rows and sites

def from_bismark(df: DataFrame) -> DataFrame:
    total = F.col("count_m") + F.col("count_um")
    return df.select("chr", "position", S.strand_of_symbol(F.col("strand")).alias("strand"), S.context_of_name(F.col("context")).alias("context"), "count_m", total.alias("count_total"), S.density(F.col("count_m"), total).alias("density"))


def from_cgmap(df: DataFrame) -> DataFrame:
    return df.select("chr", "position", S.strand_of_nucleotide(F.col("nuc")).alias("strand"), S.context_of_name(F.col("context")).alias("context"), "count_m", "count_total", "density")


def from_coverage(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("boolean")
    return df.select("chr", F.col("start").alias("position"), none.alias("strand"), none.alias("context"), "count_m", (F.col("count_m") + F.col("count_um")).alias("count_total"), "density")


def from_bedgraph(df: DataFrame) -> DataFrame:
    none, number = F.lit(None).cast("boolean"), F.lit(None).cast("long")
    return df.select("chr", F.col("start").alias("position"), none.alias("strand"), none.alias("context"), number.alias("count_m"), number.alias("count_total"), "density")


def to_bedgraph(sites: DataFrame) -> DataFrame:
    """Sites without NaN density; unknown (null) densities stay."""
    return sites.filter(F.col("density").isNull() | ~F.isnan("density")).select("chr", F.col("position").alias("start"), (F.col("position") + 1).alias("end"), "density")


def to_coverage(sites: DataFrame) -> DataFrame:
    rows = sites.filter(F.col("density").isNull() | ~F.isnan("density"))
    return rows.select("chr", F.col("position").alias("start"), (F.col("position") + 1).alias("end"), "density", "count_m", (F.col("count_total") - F.col("count_m")).alias("count_um"))


def to_bismark(sites: DataFrame) -> DataFrame:
    name = S.context_name(F.col("context"))
    return sites.select("chr", "position", S.strand_symbol(F.col("strand")).alias("strand"), "count_m", (F.col("count_total") - F.col("count_m")).alias("count_um"), name.alias("context"), name.alias("trinuc"))


def to_cgmap(sites: DataFrame) -> DataFrame:
    name = S.context_name(F.col("context"))
    return sites.select("chr", S.nucleotide(F.col("strand")).alias("nuc"), "position", name.alias("context"), F.substring(name, 1, 2).alias("dinuc"), "density", "count_m", "count_total")


FROM_REPORT = {"bismark": from_bismark, "cgmap": from_cgmap, "coverage": from_coverage, "bedgraph": from_bedgraph}
TO_REPORT = {"bismark": to_bismark, "cgmap": to_cgmap, "coverage": to_coverage, "bedgraph": to_bedgraph}


# ---------------------------------------------------------------- concatenation and checks

def check(sites: DataFrame, nulls: bool = True, single_chr: bool = False, duplicates: bool = True, width: int = WIDTH) -> DataFrame:
    """One row of violations: null_chr, null_position, chromosomes beyond the first, repeated positions."""
    out = sites.agg(
        F.coalesce(F.sum(F.col("chr").isNull().cast("long")), F.lit(0)).alias("null_chr"),
        F.coalesce(F.sum(F.col("position").isNull().cast("long")), F.lit(0)).alias("null_position"),
        F.greatest(F.count_distinct("chr") - 1, F.lit(0)).cast("long").alias("extra_chromosomes"),
    )
    repeated = sites.groupBy("chr", "position").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated_positions"))
    zero = F.lit(0).cast("long")
    out = out.join(F.broadcast(repeated))  # one row each
    return out.withColumns({c: zero for c, on in (("null_chr", nulls), ("null_position", nulls), ("extra_chromosomes", single_chr), ("repeated_positions", duplicates)) if not on})


def require(sites: DataFrame, **toggles) -> DataFrame:
    """sites, or an error that names the violations."""
    found = {k: v for k, v in check(sites, **toggles).first().asDict().items() if v}
    if found:
        raise ValueError(f"sites are not valid: {found}")
    return sites


def order_violations(rows: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """Per chromosome: in the order of column order (a number), how often a position is smaller than (unsorted) or
    equal to (repeated) the one before. Rows that order does not tell apart stand by position, so there is one answer.
    width: of the ranges of order that a task holds."""
    rows, before = previous(rows, "_before", position=order, width=width, value="position"), F.col("_before")
    flagged = rows.select("chr", (F.col("position") < before).cast("long").alias("u"), (F.col("position") == before).cast("long").alias("r"))
    return flagged.groupBy("chr").agg(F.coalesce(F.sum("u"), F.lit(0)).alias("unsorted"), F.coalesce(F.sum("r"), F.lit(0)).alias("repeated"))


def extended(a: DataFrame, b: DataFrame, checked: bool = True) -> DataFrame:
    """Both tables' rows; checked: one chromosome, no repeated position."""
    rows = a.unionByName(b)
    return require(rows, single_chr=True) if checked else rows


def concatenated(batches: list[DataFrame]) -> DataFrame:
    """Batches of one chromosome, each after the one before: a position at or before an earlier batch's end is an
    error, as is an empty list."""
    if not batches:
        raise ValueError("no batches")
    rows = reduce(DataFrame.unionByName, [b.withColumn("_batch", F.lit(k)) for k, b in enumerate(batches)])
    ends = rows.groupBy("_batch", "chr").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    bad = ends.withColumn("before", F.max("last").over(Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)))
    if ends.select("chr").distinct().count() > 1 or not bad.filter("first <= before").isEmpty():
        raise ValueError("batches are not of one chromosome in ascending order")
    return rows.drop("_batch")


def overlapping_batches(sites: DataFrame) -> DataFrame:
    """(chr, batch, previous_last, first) where a batch starts at or before the end of an earlier one."""
    ends = sites.groupBy("chr", "batch").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    before = F.max("last").over(Window.partitionBy("chr").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("previous_last", before).filter("first <= previous_last").select("chr", "batch", "previous_last", "first")


def extents(sites: DataFrame) -> DataFrame:
    """Per batch: first and last position, rows, and the contig as text. It is also the index of a batched store."""
    ends = sites.groupBy("chr", "batch").agg(F.min("position").alias("start"), F.max("position").alias("end"), F.count("*").alias("n_sites"))
    return ends.withColumn("contig", F.format_string("%s:%d-%d (.)", "chr", "start", "end"))


