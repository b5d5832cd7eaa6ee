"""Column expressions over sites, contigs and positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytolake.schema import MAX_POSITION



def nan() -> Column:
    return F.lit(float("nan"))


def density(m: Column, total: Column) -> Column:
    """Methylated share; NaN without reads, null where a count is null."""
    return F.when(total == 0, nan()).otherwise(m.cast("double") / total)


def strand_of_symbol(symbol: Column) -> Column:
    return F.when(symbol == "+", True).when(symbol == "-", False)


def strand_symbol(strand: Column) -> Column:
    return F.when(strand, "+").when(~strand, "-").otherwise(".")


def strand_of_nucleotide(nuc: Column) -> Column:
    return F.when(nuc == "C", True).when(nuc == "G", False)


def nucleotide(strand: Column) -> Column:
    return F.when(strand, "C").when(~strand, "G").otherwise(".")


def context_of_name(name: Column) -> Column:
    """Any case; what is neither CG nor CHG is CHH."""
    upper = F.translate(name, "cgh", "CGH")
    return F.when(upper == "CG", True).when(upper == "CHG", False)


def context_name(context: Column) -> Column:
    return F.when(context, "CG").when(~context, "CHG").otherwise("CHH")


def contig(seqname: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    return F.struct(seqname.alias("seqname"), start.cast("long").alias("start"), end.cast("long").alias("end"), (strand if strand is not None else F.lit(None).cast("boolean")).alias("strand"))


def contig_length(c: Column) -> Column:
    return c["end"] - c["start"]


def extend_upstream(c: Column, by: int) -> Column:
    return c.withField("start", F.greatest(F.lit(0), c["start"] - by))


def extend_downstream(c: Column, by: int) -> Column:
    return c.withField("end", F.least(F.lit(MAX_POSITION), c["end"] + by))


def set_start(c: Column, start: Column) -> Column:
    return c.withField("start", start)


def set_end(c: Column, end: Column) -> Column:
    return c.withField("end", end)


def is_in(inner: Column, outer: Column) -> Column:
    """Same sequence and contained."""
    return (inner["seqname"] == outer["seqname"]) & (inner["start"] >= outer["start"]) & (inner["end"] <= outer["end"])


def is_empty(c: Column) -> Column:
    return (c["start"] == 0) & (c["end"] == 0)


def contig_order(a: Column, b: Column) -> Column:
    """-1 or 1 for disjoint contigs of one sequence, 0 for equal ones, else null."""
    return F.when(a["seqname"] != b["seqname"], None).when((a["start"] == b["start"]) & (a["end"] == b["end"]), 0).when(a["end"] <= b["start"], -1).when(a["start"] >= b["end"], 1)


def contig_text(c: Column) -> Column:
    return F.format_string("%s:%d-%d (%s)", c["seqname"], c["start"], c["end"], strand_symbol(c["strand"]))


def position_text(seqname: Column, position: Column) -> Column:
    return F.format_string("%s:%d", seqname, position)


def shift_position(p: Column, by: int) -> Column:
    """Null below zero."""
    return F.when(p["position"] + by >= 0, p.withField("position", p["position"] + by))


def add_positions(a: Column, b: Column) -> Column:
    return F.when(a["seqname"] == b["seqname"], a.withField("position", a["position"] + b["position"]))


def subtract_positions(a: Column, b: Column) -> Column:
    return F.when((a["seqname"] == b["seqname"]) & (a["position"] >= b["position"]), a.withField("position", a["position"] - b["position"]))


def is_zero(p: Column) -> Column:
    return (p["seqname"] == "") & (p["position"] == 0)


def binomial_tail(m: Column, n: Column, mean: float) -> Column:
    """P(X > m) for n trials; NaN for n = 0, 1 for m = 0, 0 for m = n.

    Terms follow each other in logarithms, so that long products neither vanish nor overflow."""
    if not 0 < mean < 1:
        raise ValueError("mean is between 0 and 1")
    odds, start = math.log(mean / (1 - mean)), math.log(1 - mean)
    first = n.cast("double") * start
    zero = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log((n - k + 1).cast("double") / k) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    below = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m.cast("long"), F.lit(1).cast("long"))), zero, step, lambda acc: acc["sum"])
    return F.when(n == 0, nan()).when(m == 0, 1.0).when(m == n, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - below))
