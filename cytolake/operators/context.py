"""Cytosine context from sequence, and the alignment of sites with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.scalar import nan


#: Letters of a sequence that are looked at in one row.
PIECE = 8192


def _entry(position: Column, strand: bool, context: bool | None) -> Column:
    return F.struct(position.cast("long").alias("position"), F.lit(strand).alias("strand"), F.lit(context).cast("boolean").alias("context"))


def scanned(genome: DataFrame, reference: bool = True, start: int = 1) -> DataFrame:
    """(chr, position, strand, context) of a genome (chr, sequence), any case, each once. Letters other than C and G
    count as H.

    reference: windows give their first matching rule, as existing tables have it; otherwise every cytosine of both
    strands gets its context. The last pair of a sequence that ends in CG counts in both; sequences under three
    letters give nothing. A genome has each name once."""
    seq = F.translate(F.col("sequence"), "cg", "CG")
    # pieces of PIECE letters that know the two letters after them: no window looks up a place in a whole chromosome
    pieces = F.regexp_extract_all("q", F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))
    rows = genome.select("chr", seq.alias("q")).filter(F.length("q") > 2).select("chr", F.posexplode(pieces).alias("k", "piece"))
    rows = rows.repartition("chr", "k")  # a chromosome is one row, its pieces are for all tasks
    letters = F.split("piece", "")
    rows = rows.select("chr", "k", letters.alias("x"), F.slice(letters, 2, PIECE + 2).alias("y"), F.slice(letters, 3, PIECE + 2).alias("z"))
    rows = rows.select("chr", "k", F.posexplode(F.arrays_zip("x", "y", "z")).alias("i", "w")).filter((F.col("w.x") != "") & (F.col("i") < PIECE))
    rows = rows.select("chr", (F.col("k") * F.lit(PIECE).cast("long") + F.col("i") + start).alias("p"), F.col("w.x").alias("a"), F.coalesce("w.y", F.lit("")).alias("b"), F.coalesce("w.z", F.lit("")).alias("c"))
    p, a, b, c = F.col("p"), F.col("a"), F.col("b"), F.col("c")
    whole, pair = c != "", (c == "") & (b != "")
    none = F.array().cast("array<struct<position:long,strand:boolean,context:boolean>>")
    cg = (a == "C") & (b == "G")
    both = F.array(_entry(p, True, True), _entry(p + 1, False, True))
    if reference:
        found = (
            F.when((whole | pair) & cg, both)
            .when(~whole, none)
            .when((a == "C") & (b != "C") & (c == "G"), F.array(_entry(p + 2, False, False)))
            .when((a == "C") & (b != "G") & (c == "G"), F.array(_entry(p, True, False)))
            .when((a == "C") & (b != "G") & (c != "G"), F.array(_entry(p, True, None)))
            .when((a != "C") & (b != "C") & (c == "G"), F.array(_entry(p + 2, False, None)))
            .otherwise(none)
        )
    else:
        forward = F.when((whole | pair) & cg, both).when(whole & (a == "C") & (b != "G") & (c == "G"), F.array(_entry(p, True, False))).when(whole & (a == "C") & (b != "G"), F.array(_entry(p, True, None))).otherwise(none)
        back = F.when(whole & (c == "G") & (b != "C") & (a == "C"), F.array(_entry(p + 2, False, False))).when(whole & (c == "G") & (b != "C"), F.array(_entry(p + 2, False, None))).otherwise(none)
        found = F.concat(forward, back)
    out = rows.select("chr", F.explode(found).alias("e")).select("chr", "e.*")
    return out.distinct() if reference else out  # there, each position comes from one window


def aligned(sites: DataFrame, context: DataFrame) -> DataFrame:
    """Every context position once, with the sites' counts: 0 and NaN where there is no site. Strand and context come
    from the sequence; sites without a context position vanish."""
    s = sites.select("chr", "position", "count_m", "count_total", "density", F.lit(True).alias("_there"))
    rows = context.join(s, ["chr", "position"], "left")
    there = F.col("_there").isNotNull()
    zero = F.lit(0).cast("long")
    return rows.select("chr", "position", "strand", "context", *[F.when(there, F.col(c)).otherwise(zero).alias(c) for c in ("count_m", "count_total")], F.when(there, F.col("density")).otherwise(nan()).alias("density"))


def until(context: DataFrame, position: int) -> tuple[DataFrame, DataFrame]:
    """Context rows up to a position (inclusive), and the rest."""
    return context.filter(F.col("position") <= position), context.filter(F.col("position") > position)
