"""Annotation files: GFF3, BED, segment BED."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.functions.gff import attributes_text

GFF = "seqid string, source string, feature_type string, start long, end long, score string, strand string, phase string, attributes string"


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF rows; '.' is null in score and phase; lines that start with # are comments."""
    rows = spark.read.schema(GFF).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    value = lambda c, t: F.when(F.col(c) != ".", F.col(c)).cast(t).alias(c)
    return rows.select("seqid", "source", "feature_type", "start", "end", value("score", "double"), "strand", value("phase", "int"), "attributes")


def write_gff(entries: DataFrame, path: str) -> None:
    """Entries (see operators.annotation) as GFF rows."""
    strand = F.when(F.col("strand"), "+").when(~F.col("strand"), "-").otherwise(".")
    text = F.concat_ws("\t", "chr", F.coalesce("source", F.lit(".")), "feature_type", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce(F.col("score").cast("string"), F.lit(".")), strand, F.coalesce(F.col("phase").cast("string"), F.lit(".")), attributes_text(F.col("attributes")))
    entries.select(text.alias("value")).write.mode("overwrite").text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, name, score): a score that is no number is NaN."""
    rows = spark.read.schema("chr string, start long, end long, name string, score string").option("sep", "\t").option("comment", "#").csv(path)
    return rows.withColumn("score", F.coalesce(F.col("score").try_cast("double"), F.lit(float("nan"))))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, value) of BED rows whose score is a positive number; any other score is an error."""
    value = F.col("score").try_cast("double")
    fine = value.isNotNull() & (value > 0) & (value < float("inf"))
    rows = spark.read.schema("chr string, start long, end long, name string, score string").option("sep", "\t").csv(path)
    return rows.select("chr", "start", "end", F.when(fine, value).otherwise(F.raise_error(F.concat(F.lit("segment without a positive score: "), F.coalesce("score", F.lit("none")))).cast("double")).alias("value"))


def write_intervals(intervals: DataFrame, path: str, by: str | None = None) -> None:
    """BED rows by chromosome and start, the value as score; with by, a folder for each value of that column."""
    rows = intervals.orderBy(*([by] if by else []), "chr", "start").select("chr", "start", "end", F.lit(".").alias("name"), "value", *([by] if by else []))
    w = rows.write.mode("overwrite").option("sep", "\t")
    (w.partitionBy(by) if by else w).csv(path)
