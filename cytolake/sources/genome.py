"""Genomes: FASTA records and FAI indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, sequence): the name up to the first blank, the lines of a record joined."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace("value", r"^[^\n]*(\n|$)", "")
    return records.select(head.alias("chr"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(chr, length, ord) in order of the file. An index has a line per sequence: one small file, one task."""
    rows = spark.read.schema("chr string, length long, offset long, bases long, width long").option("sep", "\t").csv(path)
    return rows.select("chr", "length", "offset").withColumn("ord", F.row_number().over(_by_offset()) - 1).select("chr", "length", F.col("ord").cast("long").alias("ord"))


def _by_offset():
    from pyspark.sql import Window

    return Window.orderBy("offset")


def fasta_order(genome: DataFrame) -> DataFrame:
    """(chr, length) of FASTA records."""
    return genome.select("chr", F.length("sequence").cast("long").alias("length"))
