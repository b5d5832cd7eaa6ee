"""Annotation entries: a table with id, parent, contig columns and attributes; the tree is its (id, parent) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.gff import attributes


def entries(gff: DataFrame) -> DataFrame:
    """Entries of GFF rows: id from the attributes, or a hash of the row; attributes as a struct."""
    rows = gff.withColumn("a", attributes(F.col("attributes")))
    whole = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in gff.columns]), 256)
    return rows.select(F.coalesce(F.col("a.id"), F.substring(whole, 1, 16)).alias("id"), F.col("seqid").alias("chr"), "source", "feature_type", "start", "end", "score", F.when(F.col("strand") == "+", True).when(F.col("strand") == "-", False).alias("strand"), "phase", F.col("a").alias("attributes"))


def bed_entries(bed: DataFrame) -> DataFrame:
    """Entries of BED rows; a score that is no number is NaN."""
    whole = F.sha2(F.concat_ws("\t", "chr", "start", "end"), 256)
    score = F.coalesce(F.col("score").try_cast("double"), F.lit(float("nan"))) if "score" in bed.columns else F.lit(float("nan"))
    return bed.select(F.substring(whole, 1, 16).alias("id"), "chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), score.alias("score"))


def with_parents(rows: DataFrame) -> DataFrame:
    """Entries with their first parent's columns parent_id, parent_start, parent_end; null at the root."""
    parents = rows.select(F.col("id").alias("parent_id"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end"))
    return rows.withColumn("_p", F.get(F.col("attributes.parent"), F.lit(0))).join(parents, F.col("_p") == F.col("parent_id"), "left").drop("_p")


def orphans(edges: DataFrame) -> DataFrame:
    """Edges (id, parent) whose parent is not an id."""
    ids = edges.select(F.col("id").alias("_known")).distinct()
    return edges.filter(F.col("parent").isNotNull()).join(ids, F.col("parent") == F.col("_known"), "left_anti")


def twice_parented(edges: DataFrame) -> DataFrame:
    """Ids with more than one parent."""
    return edges.groupBy("id").agg(F.count_distinct("parent").alias("n_parents")).filter("n_parents > 1")


def children(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.array_sort(F.collect_list("id")).alias("children"))


def without_subtree(edges: DataFrame, root: str) -> DataFrame:
    """Edges without root and all below it; one join per level."""
    gone = edges.filter(F.col("id") == root).select("id")
    level = gone
    while not level.isEmpty():
        level = edges.join(level.select(F.col("id").alias("_up")), F.col("parent") == F.col("_up")).select("id").join(gone, "id", "left_anti")
        gone = gone.unionByName(level)
    return edges.join(gone, "id", "left_anti")


def flanks(rows: DataFrame, flank: int, chosen: Column, prefix: str = "flank_") -> DataFrame:
    """Entries for the flanks of the chosen ones: after the end for a positive length, before the start for a negative
    one. Their parent is the entry; they have no strand."""
    end = F.col("end") + flank if flank > 0 else F.col("start")
    start = F.col("end") if flank > 0 else F.greatest(F.lit(0), F.col("start") + flank)
    return rows.filter(chosen).select(F.concat("id", F.lit(f"_flank_{flank}")).alias("id"), "chr", start.cast("long").alias("start"), end.cast("long").alias("end"), F.concat(F.lit(prefix), F.col("feature_type")).alias("feature_type"), F.col("id").alias("parent"), F.lit(None).cast("boolean").alias("strand"))


def matching(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.filter(F.col("id").rlike(pattern))


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature_type").agg(F.array_sort(F.collect_list("id")).alias("ids"))
