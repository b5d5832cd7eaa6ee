"""Queries that go through files: what a writer stores, a reader gives back. Each writes the whole table to a new folder
of the shared one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.operators import annotation, bins, context, intervals, ordering, sites
from cytolake.plans import adapter, cli
from cytolake.plans.adapter import GENOME, REGIONS, SITES, WIDTH
from cytolake.sources import annot, arrow_ipc, genome, native, reports
from cytolake.sources.shared import scratch
from cytolake.streaming import ingest

COLUMNS = "chr, position, strand, context, count_m, count_total, density"
ORDER = ["chr3", "chr1", "chr5", "chr2", "chr4"]
_RANK = "CASE chr WHEN 'chr3' THEN 0 WHEN 'chr1' THEN 1 WHEN 'chr5' THEN 2 WHEN 'chr2' THEN 3 ELSE 4 END"
_BATCHED = "batched AS (SELECT *, (row_number() OVER (PARTITION BY chr ORDER BY position) - 1) // 1000 AS batch FROM sites)"
#: Bases of a document's text: letters other than A, C, G and T count as unknown.
_BASES = "regexp_replace(translate(sequence, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g')"


def report(spark: SparkSession, d: str, kind: str, codec: str | None) -> DataFrame:
    path = scratch(spark, "report")
    reports.write_report(adapter.sites(spark, d), path, kind, codec, 6)
    return sites.FROM_REPORT[kind](reports.read_rows(spark, path, kind))


def fasta(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fasta")
    bases = F.regexp_replace(F.translate("sequence", "acgt", "ACGT"), "[^ACGT]", "N")
    lines = F.concat(F.lit(">"), "chr", F.lit(" a document\n"), F.regexp_replace(bases, "(.{60})", "$1\n"))
    adapter.genome(spark, d).select(lines.alias("value")).write.text(path)
    return genome.read_fasta(spark, path).select("chr", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest"))


def fai(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fai")
    rows = adapter.genome(spark, d).select("chr", F.length("sequence").alias("length"), (F.col("chr").cast("long") * 1000).alias("offset"), F.lit(60).alias("bases"), F.lit(61).alias("width"))
    rows.write.option("sep", "\t").csv(path)
    return genome.read_fai(spark, path)


def arrow(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "arrow")
    spark.dataSource.register(arrow_ipc.ArrowIPC)
    for mode in ("append", "overwrite"):  # the second write replaces the first
        adapter.sites(spark, d).write.format("arrow_ipc").option("compression", "zstd").mode(mode).save(path)
    return spark.read.format("arrow_ipc").load(path)


def store(spark: SparkSession, d: str, label: str = "store", chunk: int = 1000) -> str:
    path = scratch(spark, label)
    native.write(adapter.sites(spark, d), path, chunk, ordering.chr_order(spark, ORDER), range_width=WIDTH)
    return path


def ordered_store(spark: SparkSession, d: str) -> DataFrame:
    path = store(spark, d)
    rows = native.read_sorted(spark, path)
    return rows.join(native.read_order(spark, path), "chr")


def index(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "index")
    native.write_index(native.read(spark, store(spark, d)), path)
    return native.read_index(spark, path).select("chr", "batch", "start", "end", "n_sites")


def gff(spark: SparkSession, d: str, entries: DataFrame) -> DataFrame:
    path = scratch(spark, "gff")
    annot.write_gff(entries, path)
    back = annotation.entries(annot.read_gff(spark, path))
    return back.select("id", "chr", "feature_type", "start", "end", "strand", F.col("attributes.name")[0].alias("name"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bed")
    annot.write_intervals(_valued(spark, d), path)
    return annot.read_segments(spark, path)


def bed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bed")
    score = F.when(F.col("region_id") % 2 == 0, (F.col("region_id") % 7).cast("string")).otherwise("none")
    adapter.regions(spark, d).select("chr", "start", "end", F.col("region_id").cast("string").alias("name"), score.alias("score")).write.option("sep", "\t").csv(path)
    rows = annot.read_bed(spark, path)
    return annotation.bed_entries(rows).select("chr", "start", "end", "score", F.length("id").alias("id_length"))


def _valued(spark: SparkSession, d: str) -> DataFrame:
    return adapter.regions(spark, d).select("chr", "start", "end", (F.col("region_id") % 7 + 1).cast("double").alias("value"))


def _run(spark: SparkSession, *args: str) -> None:
    cli.main(list(args), spark)


def to_native(spark: SparkSession, d: str) -> DataFrame:
    """Report and index of the genome into a store, by the command line."""
    source, index_path, target = scratch(spark, "report"), scratch(spark, "fai"), scratch(spark, "store")
    reports.write_report(adapter.sites(spark, d), source, "cgmap", "gzip")
    spark.createDataFrame([(c, 10**9, k, 60, 61) for k, c in enumerate(ORDER)], "chr string, length long, offset long, bases long, width long").coalesce(1).write.option("sep", "\t").csv(index_path)
    _run(spark, "to-native", source, target, "--kind", "cgmap", "--fai", index_path, "--chunk", "1000")
    return native.read(spark, target)


def from_native(spark: SparkSession, d: str) -> DataFrame:
    target = scratch(spark, "report")
    _run(spark, "from-native", store(spark, d), target, "--kind", "bismark", "--compression", "gzip")
    return sites.from_bismark(reports.read_rows(spark, target, "bismark"))


def sort_command(spark: SparkSession, d: str) -> DataFrame:
    source, target = scratch(spark, "store"), scratch(spark, "store")
    native.write(adapter.sites(spark, d), source, 1000, range_width=WIDTH)
    _run(spark, "sort", source, target, "--order", "chr5", "chr2")
    rows = native.read(spark, target).select("chr", "position")
    return rows.join(native.read_order(spark, target), "chr")


def merge_command(spark: SparkSession, d: str) -> DataFrame:
    """Step functions of two sets of regions on common breakpoints."""
    a, b, out = scratch(spark, "bed"), scratch(spark, "bed"), scratch(spark, "merged")
    tiles = adapter.sites(spark, d).select("chr", F.floor(F.col("position") / 5000).cast("long").alias("t")).distinct()
    annot.write_intervals(tiles.select("chr", (F.col("t") * 5000).alias("start"), (F.col("t") * 5000 + 5000).alias("end"), (F.col("t") % 5 + 1).cast("double").alias("value")), a)
    annot.write_intervals(tiles.select("chr", (F.col("t") * 5000 + 1000).alias("start"), (F.col("t") * 5000 + 4000).alias("end"), (F.col("t") % 3 + 1).cast("double").alias("value")), b)
    _run(spark, "merge", a, b, "--output", out)
    rows = spark.read.schema("chr string, start long, end long, name string, value double, number int").option("sep", "\t").csv(out)
    return rows.select("number", "chr", "start", "end", F.round("value", 6).alias("value"))


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """Reports that appear in a folder, into a store."""
    folder, target, checkpoint = (scratch(spark, x) for x in ("reports", "store", "progress"))
    reports.write_report(adapter.sites(spark, d), folder, "bismark")
    ingest.append(spark, folder, "bismark", target, checkpoint, 5000).awaitTermination()
    return native.read(spark, target)


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    one = adapter.sites(spark, d).filter("chr = 'chr1'")
    return context.until(one, 20_000)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return bins.region_lines(adapter.regions(spark, d), adapter.sites(spark, d))


def register(add: Callable) -> None:
    """Every query of this module, with its SQL."""
    known = {"bismark": COLUMNS, "cgmap": COLUMNS, "coverage": "chr, position, CAST(NULL AS BOOLEAN) AS strand, CAST(NULL AS BOOLEAN) AS context, count_m, count_total, density", "bedgraph": "chr, position, CAST(NULL AS BOOLEAN) AS strand, CAST(NULL AS BOOLEAN) AS context, CAST(NULL AS BIGINT) AS count_m, CAST(NULL AS BIGINT) AS count_total, density"}
    for kind, codec in (("bismark", None), ("cgmap", "gzip"), ("coverage", "bzip2"), ("bedgraph", None)):
        add(f"file_{kind}", lambda spark, d, k=kind, c=codec: report(spark, d, k, c), f"SELECT {known[kind]} FROM sites", SITES)
    add("file_fasta", fasta, f"SELECT chr, length({_BASES}) AS length, md5({_BASES}) AS digest FROM genome", GENOME)
    add("fasta_lengths", lambda spark, d: genome.fasta_order(adapter.genome(spark, d)), "SELECT chr, length(sequence) AS length FROM genome", GENOME)
    add("file_fai", fai, "SELECT chr, length(sequence) AS length, row_number() OVER (ORDER BY CAST(chr AS BIGINT)) - 1 AS ord FROM genome", GENOME)
    add("file_arrow_ipc", arrow, f"SELECT {COLUMNS} FROM sites", SITES)
    add("store_in_order", ordered_store, f"SELECT {COLUMNS}, batch, {_RANK}::BIGINT AS ord FROM batched", SITES, _BATCHED)
    add("store_index", index, 'SELECT chr, batch, min(position) AS start, max(position) AS "end", count(*) AS n_sites FROM batched GROUP BY 1, 2', SITES, _BATCHED)
    add("store_nth_batch", lambda spark, d: native.nth(native.read(spark, store(spark, d)), 3).select("chr", "batch", "position"), ", k AS (SELECT *, dense_rank() OVER (ORDER BY chr, batch) - 1 AS i FROM batched) SELECT chr, batch, position FROM k WHERE i = 3", SITES, _BATCHED)
    add("store_batches", lambda spark, d: native.batches(native.read(spark, store(spark, d)), 0, 2).select("chr", "batch", "position"), "SELECT chr, batch, position FROM batched WHERE batch IN (0, 2)", SITES, _BATCHED)
    add("file_segments", segments, 'SELECT chr, start, "end", (region_id % 7 + 1)::DOUBLE AS value FROM regions', REGIONS)
    add("file_bed", bed, "SELECT chr, start, \"end\", CASE WHEN region_id % 2 = 0 THEN (region_id % 7)::DOUBLE ELSE CAST('nan' AS DOUBLE) END AS score, 16 AS id_length FROM regions", REGIONS)
    add("command_to_native", to_native, f"SELECT {COLUMNS}, batch FROM batched", SITES, _BATCHED)
    add("command_from_native", from_native, f"SELECT {COLUMNS} FROM sites", SITES)
    add("command_sort", sort_command, "SELECT chr, position, CASE chr WHEN 'chr5' THEN 0 ELSE 1 END::BIGINT AS ord FROM sites WHERE chr IN ('chr5', 'chr2')", SITES)
    add("command_merge", merge_command, """, t AS (SELECT DISTINCT chr, position // 5000 AS t FROM sites
), s AS (SELECT 0 AS number, chr, t * 5000 AS a, t * 5000 + 5000 AS b, (t % 5 + 1)::DOUBLE AS value FROM t UNION ALL SELECT 1, chr, t * 5000 + 1000, t * 5000 + 4000, (t % 3 + 1)::DOUBLE FROM t
), p AS (SELECT chr, a AS p FROM s UNION SELECT chr, b FROM s
), bins AS (SELECT * FROM (SELECT chr, lag(p) OVER (PARTITION BY chr ORDER BY p) AS start, p AS "end" FROM p) WHERE start IS NOT NULL)
SELECT n.number, bins.chr, start, "end", round(coalesce(max(value), CAST('nan' AS DOUBLE)), 6) AS value
FROM (SELECT DISTINCT number, chr FROM s) n JOIN bins USING (chr) LEFT JOIN s ON s.number = n.number AND s.chr = bins.chr AND a < "end" AND b > start GROUP BY ALL""", SITES)
    add("stream_store", streamed, f"SELECT {COLUMNS}, position // 5000 AS batch FROM sites", SITES)
    add("context_until", lambda spark, d: halves(spark, d)[0].select("position", F.lit(True).alias("before")).unionByName(halves(spark, d)[1].select("position", F.lit(False).alias("before"))), "SELECT position, position <= 20000 AS before FROM sites WHERE chr = 'chr1'", SITES)
    add("sites_extended", lambda spark, d: sites.extended(*halves(spark, d)), f"SELECT {COLUMNS} FROM sites WHERE chr = 'chr1'", SITES)
    add("sites_concatenated", lambda spark, d: sites.concatenated(list(halves(spark, d))), f"SELECT {COLUMNS} FROM sites WHERE chr = 'chr1'", SITES)
    add("sites_distinct", lambda spark, d: adapter.sites(spark, d).unionByName(adapter.sites(spark, d)).distinct(), f"SELECT {COLUMNS} FROM sites", SITES)
    add("sites_from_columns", lambda spark, d: sites.from_columns(spark, "c", [3, 5, 9], [True, False, None], [True, None, False], [1, 0, 4], [2, 0, 5]).unionByName(sites.empty(spark)), "SELECT 'c' AS chr, * FROM (VALUES (3::BIGINT, true, true, 1::BIGINT, 2::BIGINT, 0.5::DOUBLE), (5, false, NULL, 0, 0, CAST('nan' AS DOUBLE)), (9, NULL, false, 4, 5, 0.8)) t(position, strand, context, count_m, count_total, density)")
    add("region_lines", lambda spark, d: lines(spark, d).select("region_id", F.size("positions").cast("long").alias("n"), F.round(F.array_max("positions"), 6).alias("last"), F.round(F.aggregate("densities", F.lit(0.0), lambda a, x: a + x), 6).alias("total")), 'SELECT region_id, count(*) AS n, round(max((position - start)::DOUBLE / ("end" - start)), 6) AS last, round(sum(density), 6) AS total FROM sites JOIN regions USING (chr) WHERE position >= start AND position < "end" GROUP BY 1', SITES, REGIONS)
    add("line_counts", lambda spark, d: bins.point_counts(lines(spark, d)).withColumn("mean_points", F.round("mean_points", 6)), ', l AS (SELECT region_id, count(*) AS n FROM sites JOIN regions USING (chr) WHERE position >= start AND position < "end" GROUP BY 1) SELECT count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_points, round(avg(n), 6) AS mean_points FROM l', SITES, REGIONS)
    # densities over 1 are no densities of a plot: sites with more methylated than all reads
    add("invalid_lines", lambda spark, d: bins.invalid_lines(lines(spark, d)).select("region_id"), 'SELECT DISTINCT region_id FROM sites JOIN regions USING (chr) WHERE position >= start AND position < "end" AND NOT isnan(density) AND density > 1', SITES, REGIONS)
    add("from_breakpoints_reference", lambda spark, d: intervals.from_breakpoints(intervals.breakpoints(adapter.regions(spark, d)).distinct(), True), 'SELECT chr, 0::BIGINT AS start, position AS "end" FROM (SELECT chr, start AS position FROM regions UNION SELECT chr, "end" FROM regions)', REGIONS)
