"""Command line: python -m cytolake.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cytolake.config import merge_type
from cytolake.operators.replicates import sampled
from cytolake.plans import convert, dimred, dmr, validate
from cytolake.sources import native
from cytolake.sources.annot import read_segments, write_intervals
from cytolake.sources.shared import existing


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cytolake")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("to-native", help="report into a store")
    c.add_argument("report"), c.add_argument("store")
    c.add_argument("--kind", default="bismark"), c.add_argument("--fasta"), c.add_argument("--fai"), c.add_argument("--chunk", type=int, default=10_000)
    c = sub.add_parser("from-native", help="store into a report")
    c.add_argument("store"), c.add_argument("report"), c.add_argument("--kind", default="bismark"), c.add_argument("--compression")
    c = sub.add_parser("report-to-report")
    c.add_argument("source"), c.add_argument("target"), c.add_argument("--kind", required=True), c.add_argument("--to", required=True), c.add_argument("--fasta", required=True), c.add_argument("--compression")
    c = sub.add_parser("dmr", help="differentially methylated regions")
    c.add_argument("--a", nargs="+", required=True), c.add_argument("--b", nargs="+", required=True), c.add_argument("--output", required=True)
    o = dmr.Options()
    for name, value in vars(o).items():
        c.add_argument("--" + name.replace("_", "-"), type=type(value), default=value)
    c = sub.add_parser("shrink", help="change points")
    c.add_argument("stores", nargs="+"), c.add_argument("--output", required=True), c.add_argument("--context", default="CG"), c.add_argument("--coverage", type=int, default=5), c.add_argument("--beta", type=float), c.add_argument("--min-size", type=int, default=20), c.add_argument("--chunk", type=int, default=10_000), c.add_argument("--overlap", type=int, default=1_000), c.add_argument("--joint", type=int, default=5)
    c = sub.add_parser("merge", help="step functions on common breakpoints: a folder number=K of BED rows for each input")
    c.add_argument("beds", nargs="+"), c.add_argument("--output", required=True), c.add_argument("--how", default="full")
    c = sub.add_parser("validate")
    c.add_argument("stores", nargs="+"), c.add_argument("--deep", action="store_true")
    c = sub.add_parser("sort")
    c.add_argument("source"), c.add_argument("target"), c.add_argument("--order", nargs="+")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("cytolake").getOrCreate()
    given = {"to-native": lambda: [a.report, *filter(None, (a.fasta, a.fai))], "from-native": lambda: [a.store], "report-to-report": lambda: [a.source, a.fasta], "dmr": lambda: a.a + a.b, "shrink": lambda: a.stores, "merge": lambda: a.beds, "validate": lambda: a.stores, "sort": lambda: [a.source]}
    existing(spark, *given[a.command]())
    stores = lambda paths: sampled({p: native.read(spark, p) for p in paths})
    if a.command == "to-native":
        convert.to_native(spark, a.report, a.kind, a.store, a.fasta, a.fai, a.chunk)
    elif a.command == "from-native":
        convert.from_native(spark, a.store, a.report, a.kind, a.compression)
    elif a.command == "report-to-report":
        convert.report_to_report(spark, a.source, a.kind, a.target, a.to, a.fasta, a.compression)
    elif a.command == "dmr":
        o = dmr.Options(**{k: getattr(a, k) for k in vars(dmr.Options())})
        found = dmr.regions(stores(a.a + a.b), F.col("sample").isin(*a.a), F.col("sample").isin(*a.b), len(a.a), len(a.b), o)
        dmr.write(found, a.output, o)
    elif a.command == "shrink":
        write_intervals(dimred.shrink(stores(a.stores), a.context, a.coverage, a.beta, a.min_size, a.chunk, a.overlap, a.joint), a.output)
    elif a.command == "merge":
        rows = sampled({p: read_segments(spark, p) for p in a.beds})
        numbers = spark.createDataFrame([(p, k) for k, p in enumerate(a.beds)], "sample string, number int")
        write_intervals(dimred.merge(rows, merge_type(a.how)).join(numbers, "sample"), a.output, by="number")
    elif a.command == "validate":
        found = validate.validate(stores(a.stores), a.deep)
        print("\n".join(found) or "the files agree")
        return 1 if found else 0
    else:
        convert.sort(spark, a.source, a.target, a.order)
    return 0


if __name__ == "__main__":
    sys.exit(main())
