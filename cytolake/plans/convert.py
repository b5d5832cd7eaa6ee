"""Conversions between reports and stores, and sorting of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytolake.operators.context import scanned
from cytolake.operators.ordering import chr_order, sites_sorted
from cytolake.sources import native
from cytolake.sources.genome import read_fai, read_fasta
from cytolake.sources.reports import read_sites, write_report


def to_native(spark: SparkSession, report: str, kind: str, path: str, fasta: str | None = None, fai: str | None = None, chunk: int = 10_000, codec: str = "zstd") -> None:
    """A report into a native store. A genome or its index gives the chromosomes; formats without strand need the
    genome itself."""
    if fasta is None and fai is None:
        raise ValueError("a FASTA file or its index is needed")
    genome = read_fasta(spark, fasta) if fasta else None
    context = scanned(genome) if genome is not None else None
    order = read_fai(spark, fai) if fai else genome.select("chr").distinct()
    native.write(read_sites(spark, report, kind, context), path, chunk, order, codec)


def from_native(spark: SparkSession, path: str, report: str, kind: str = "bismark", codec: str | None = None) -> None:
    write_report(native.read(spark, path).drop("batch"), report, kind, codec)


def report_to_report(spark: SparkSession, source: str, kind: str, target: str, to: str, fasta: str, codec: str | None = None) -> None:
    """One text format into another, aligned with a genome."""
    write_report(read_sites(spark, source, kind, scanned(read_fasta(spark, fasta))), target, to, codec)


def sort(spark: SparkSession, source: str, target: str, order: list[str] | None = None, chunk: int = 10_000) -> DataFrame:
    """A store with only the chromosomes of order, which keeps that order, and its rows in it (by name without one)."""
    sites = native.read(spark, source).drop("batch")
    names = chr_order(spark, order) if order else None
    native.write(sites, target, chunk, names)
    return sites_sorted(sites, names)
