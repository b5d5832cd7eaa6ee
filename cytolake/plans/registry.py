"""Named queries over the driver's tables, each with its SQL where SQL can express it. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.functions import gff, scalar
from cytolake.functions.aggregates import over_rows
from cytolake.operators import annotation, bins, context, intervals, ordering, pvalues, ranges, replicates, sites, stats
from cytolake.plans import adapter, dimred, dmr, trips, validate
from cytolake.plans.adapter import GENOME, REGIONS, SAMPLES, SITES, STEPS, WIDTH

QUERIES: dict = {}
SQL: dict = {}

_CTX = "CASE WHEN context THEN 'CG' WHEN NOT context THEN 'CHG' ELSE 'CHH' END"
_STRAND = "CASE WHEN strand THEN '+' WHEN NOT strand THEN '-' ELSE '.' END"
_COLUMNS = "chr, position, strand, context, count_m, count_total, density"


def _add(name: str, run, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = f"WITH {', '.join(ctes)}{'' if sql.startswith(',') else ' '}{sql}" if ctes else sql


def _on_sites(name: str, f, sql: str | None = None, *ctes: str) -> None:
    _add(name, lambda spark, d: f(adapter.sites(spark, d)), sql, SITES, *ctes)


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order: rounded."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---------------------------------------------------------------- sites and filters
_on_sites("sites_from_lineitem", lambda s: s, f"SELECT {_COLUMNS} FROM sites")
for _name, _test, _where in (
    ("filter_pos_lt", lambda: sites.pos_lt(20_000), "position < 20000"),
    ("filter_pos_gt", lambda: sites.pos_gt(20_000), "position > 20000"),
    ("filter_coverage", lambda: sites.coverage_gt(30), "count_total > 30"),
    ("filter_strand", lambda: sites.strand_is(True), "strand"),
    ("filter_strand_none", lambda: sites.strand_is(None), "strand IS NULL"),
    ("filter_context_cg", lambda: sites.context_is("CG"), "context"),
    ("filter_context_chg", lambda: sites.context_is("CHG"), "NOT context"),
    ("filter_context_chh", lambda: sites.context_is("CHH"), "context IS NULL"),
):
    _on_sites(_name, lambda s, t=_test: s.filter(t()), f"SELECT {_COLUMNS} FROM sites WHERE {_where}")
_on_sites("filter_chain", lambda s: sites.filtered(s, sites.pos_gt(1_000), sites.coverage_gt(10), sites.strand_is(False), sites.context_is("CHG")), f"SELECT {_COLUMNS} FROM sites WHERE position > 1000 AND count_total > 10 AND NOT strand AND NOT context")
_on_sites("slice_rows", lambda s: sites.sliced(s, 100, 500, WIDTH), f"SELECT {_COLUMNS} FROM sites QUALIFY row_number() OVER (PARTITION BY chr ORDER BY position) BETWEEN 101 AND 600")
_on_sites("masked_counts", lambda s: sites.masked(s, F.col("count_total") > 20, ["count_m", "density"]), "SELECT chr, position, strand, context, CASE WHEN count_total > 20 THEN count_m END AS count_m, count_total, CASE WHEN count_total > 20 THEN density END AS density FROM sites")
_on_sites("strict_cast", sites.cast, f"SELECT {_COLUMNS} FROM sites")

# ---------------------------------------------------------------- reports
_on_sites("to_bedgraph", sites.to_bedgraph, "SELECT chr, position AS start, position + 1 AS \"end\", density FROM sites WHERE density IS NULL OR NOT isnan(density)")
_on_sites("to_coverage", sites.to_coverage, "SELECT chr, position AS start, position + 1 AS \"end\", density, count_m, count_total - count_m AS count_um FROM sites WHERE density IS NULL OR NOT isnan(density)")
_on_sites("to_bismark", sites.to_bismark, f"SELECT chr, position, {_STRAND} AS strand, count_m, count_total - count_m AS count_um, {_CTX} AS context, {_CTX} AS trinuc FROM sites")
_on_sites("to_cgmap", sites.to_cgmap, f"SELECT chr, CASE WHEN strand THEN 'C' WHEN NOT strand THEN 'G' ELSE '.' END AS nuc, position, {_CTX} AS context, substr({_CTX}, 1, 2) AS dinuc, density, count_m, count_total FROM sites")
_on_sites("from_bismark", lambda s: sites.from_bismark(sites.to_bismark(s)), f"SELECT {_COLUMNS} FROM sites")
_on_sites("from_cgmap", lambda s: sites.from_cgmap(sites.to_cgmap(s)), f"SELECT {_COLUMNS} FROM sites")
_on_sites("from_coverage", lambda s: sites.from_coverage(sites.to_coverage(s)), "SELECT chr, position, CAST(NULL AS BOOLEAN) AS strand, CAST(NULL AS BOOLEAN) AS context, count_m, count_total, density FROM sites")
_on_sites("from_bedgraph", lambda s: sites.from_bedgraph(sites.to_bedgraph(s)), "SELECT chr, position, CAST(NULL AS BOOLEAN) AS strand, CAST(NULL AS BOOLEAN) AS context, CAST(NULL AS BIGINT) AS count_m, CAST(NULL AS BIGINT) AS count_total, density FROM sites")

# ---------------------------------------------------------------- statistics
_on_sites("context_stats", lambda s: _r(stats.region_stats(s).filter("kind = 'context'").select(F.col("label").alias("context"), "sum_density", "n", "mean"), "sum_density", "mean"), f"SELECT {_CTX} AS context, round(sum(density), 6) AS sum_density, count(density) AS n, round(avg(density), 6) AS mean FROM sites GROUP BY 1")
_on_sites("strand_stats", lambda s: _r(stats.region_stats(s).filter("kind = 'strand'").select(F.col("label").alias("strand"), "sum_density", "n", "mean"), "sum_density", "mean"), f"SELECT {_STRAND} AS strand, round(sum(density), 6) AS sum_density, count(density) AS n, round(avg(density), 6) AS mean FROM sites GROUP BY 1")
_on_sites("coverage_hist", stats.coverage_histogram, "SELECT count_total, count(*) AS n FROM sites GROUP BY 1")
_on_sites("region_stats_grouping_sets", lambda s: _r(stats.grouping_sets(s), "mean_density"), f"SELECT chr, context, strand, count(*) AS n_sites, CAST(sum(count_m) AS BIGINT) AS sum_m, CAST(sum(count_total) AS BIGINT) AS sum_total, round(avg(density), 6) AS mean_density FROM (SELECT chr, {_CTX} AS context, {_STRAND} AS strand, count_m, count_total, density FROM sites) GROUP BY GROUPING SETS ((chr, context), (chr, strand), ())")
_on_sites("partial_stats_merge", lambda s: _r(stats.finalized(stats.merged_partials(stats.partials(s.withColumn("slot", F.col("position") % 16), "chr", "slot"), "chr")), "sum_density", "mean"), "SELECT chr, round(sum(density), 6) AS sum_density, count(density) AS n, round(avg(density), 6) AS mean FROM sites GROUP BY chr")
_on_sites("aggregate_methods", lambda s: _r(s.groupBy("chr").agg(*[over_rows(a, F.col("density")).alias(a) for a in ("mean", "sum", "gmean", "median", "max", "min")]), "mean", "sum", "gmean", "median", "max", "min"), "SELECT chr, round(avg(density), 6) AS mean, round(sum(density), 6) AS sum, round(CASE WHEN min(density) > 0 THEN exp(avg(ln(nullif(density, 0)))) ELSE 0 END, 6) AS gmean, round(median(density), 6) AS median, round(max(density), 6) AS max, round(min(density), 6) AS min FROM sites GROUP BY chr")

# ---------------------------------------------------------------- replicates
_SQL_AGG = {"sum": ("sum", "sum"), "median": ("median", "median"), "max": ("max", "max"), "min": ("min", "min"), "mean": ("avg", "avg")}
for _name, _counts, _density in (("merge_replicates_sum_mean", "sum", "mean"), ("merge_replicates_median", "median", "median"), ("merge_replicates_max", "max", "max"), ("merge_replicates_min", "min", "min")):
    _c, _d = _SQL_AGG[_counts][0], _SQL_AGG[_density][1]
    _add(_name, lambda spark, d, c=_counts, e=_density: _r(replicates.merged(adapter.samples(spark, d), c, e), "density"), f"SELECT chr, position, strand, context, CAST(trunc({_c}(CAST(count_m AS DOUBLE))) AS BIGINT) AS count_m, CAST(trunc({_c}(CAST(count_total AS DOUBLE))) AS BIGINT) AS count_total, round({_d}(density), 6) AS density FROM samples GROUP BY chr, position, strand, context", SAMPLES)
_add("merge_replicates_gmean", lambda spark, d: _r(replicates.merged(adapter.samples(spark, d), "sum", "gmean"), "density"), "SELECT chr, position, strand, context, CAST(sum(count_m) AS BIGINT) AS count_m, CAST(sum(count_total) AS BIGINT) AS count_total, round(CASE WHEN min(density) > 0 THEN exp(avg(ln(nullif(density, 0)))) ELSE 0 END, 6) AS density FROM samples GROUP BY chr, position, strand, context", SAMPLES)
_add("merge_replicates_function", lambda spark, d: _r(replicates.merged(adapter.samples(spark, d), lambda c: F.max(c) - F.min(c), lambda c: F.max(c) - F.min(c)), "density"), "SELECT chr, position, strand, context, CAST(max(count_m) - min(count_m) AS BIGINT) AS count_m, CAST(max(count_total) - min(count_total) AS BIGINT) AS count_total, round(max(density) - min(density), 6) AS density FROM samples GROUP BY 1, 2, 3, 4", SAMPLES)
_add("missing_per_site", lambda spark, d: replicates.missing(adapter.samples(spark, d), 4), "SELECT chr, position, 4 - count(DISTINCT CASE WHEN density IS NOT NULL THEN sample END) AS n_missing FROM samples GROUP BY chr, position", SAMPLES)


def _pairs(spark, d):
    return replicates.paired(adapter.samples(spark, d), F.col("sample") < 2, F.col("sample") >= 2)


_PAIRS = """pairs AS (SELECT chr, position, avg(density) FILTER (WHERE sample < 2) AS density_a, avg(density) FILTER (WHERE sample >= 2) AS density_b
  FROM samples GROUP BY chr, position HAVING count(*) FILTER (WHERE sample < 2) > 0 AND count(*) FILTER (WHERE sample >= 2) > 0)"""
_add("paired_groups", lambda spark, d: _r(_pairs(spark, d), "density_a", "density_b"), "SELECT chr, position, round(density_a, 6) AS density_a, round(density_b, 6) AS density_b FROM pairs", SAMPLES, _PAIRS)

# ---------------------------------------------------------------- bins
_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY position) - 1 AS o, min(position) OVER (PARTITION BY chr) AS f, max(position) OVER (PARTITION BY chr) AS l FROM sites)"
_on_sites("partition_breakpoints", lambda s: _r(bins.partition(s, [10, 100, 500], "mean", WIDTH), "rel_end", "value"), """, parts AS (SELECT chr, CAST((o >= 10)::INT + (o >= 100)::INT + (o >= 500)::INT AS BIGINT) AS part, min(position) AS start, count(*) AS n, avg(density) AS value, min(f) AS f, max(l) AS l FROM numbered GROUP BY 1, 2)
SELECT chr, part, round(coalesce(CAST(lead(start) OVER (PARTITION BY chr ORDER BY part) - f AS DOUBLE) / (l + 1 - f), 1), 6) AS rel_end, n, round(value, 6) AS value FROM parts""", _NUMBERED)
for _agg in ("mean", "median"):
    _fn = {"mean": "avg", "median": "median"}[_agg]
    _on_sites(f"discretise_{_agg}", lambda s, a=_agg: _r(bins.discretised(s, 10, a), "rel_end", "value"), f""", extent AS (SELECT chr, min(position) AS f, max(position) + 1 - min(position) AS len FROM sites GROUP BY chr
), spine AS (SELECT chr, f, len, CAST(b AS BIGINT) AS bin FROM extent, range(0, 10) t(b)
), placed AS (SELECT s.chr, position, density, len(list_filter(list_transform(range(1, 10), lambda i: round(f + i * len / 10.0)), lambda x: x <= position)) AS bin FROM sites s JOIN extent USING (chr)
), found AS (SELECT chr, CAST(bin AS BIGINT) AS bin, min(position) AS start, count(*) AS n, {_fn}(density) AS value FROM placed GROUP BY 1, 2
)
SELECT spine.chr, spine.bin, round(coalesce(CAST((SELECT min(n.start) FROM found n WHERE n.chr = spine.chr AND n.bin > spine.bin) - f AS DOUBLE) / len, 1), 6) AS rel_end, coalesce(n, 0) AS n, round(coalesce(value, CAST('nan' AS DOUBLE)), 6) AS value
FROM spine LEFT JOIN found USING (chr, bin)""")
_LINES = "points AS (SELECT CAST(position - start AS DOUBLE) / (\"end\" - start) AS x, density AS y FROM sites JOIN regions USING (chr) WHERE position >= start AND position < \"end\")"


def _points(spark, d):
    rows = intervals.in_regions(adapter.sites(spark, d), adapter.regions(spark, d))
    return rows.select(((F.col("position") - F.col("start")) / (F.col("end") - F.col("start"))).alias("x"), F.col("density").alias("y"))


_add("line_plot_bins", lambda spark, d: _r(bins.line_plot(_points(spark, d), 21), "x", "y"), """, binned AS (SELECT len(list_filter(range(0, 21), lambda k: k * (1.0::DOUBLE / 20) <= x)) AS bin, x, y FROM points)
SELECT CAST(b AS BIGINT) AS bin, count(x) AS n_points, round(coalesce(avg(x), CAST('nan' AS DOUBLE)), 6) AS x, round(coalesce(avg(y), CAST('nan' AS DOUBLE)), 6) AS y FROM range(0, 22) t(b) LEFT JOIN binned ON b = bin GROUP BY b""", SITES, REGIONS, _LINES)
_add("line_plot_function", lambda spark, d: _r(bins.line_plot(_points(spark, d), 21, lambda c: F.max(c) - F.min(c)), "x", "y").filter("n_points > 0"), """, binned AS (SELECT len(list_filter(range(0, 21), lambda k: k * (1.0::DOUBLE / 20) <= x)) AS bin, x, y FROM points)
SELECT CAST(bin AS BIGINT) AS bin, count(x) AS n_points, round(avg(x), 6) AS x, round(max(y) - min(y), 6) AS y FROM binned GROUP BY 1""", SITES, REGIONS, _LINES)
_add("line_point_counts", lambda spark, d: _r(intervals.in_regions(adapter.sites(spark, d), adapter.regions(spark, d)).groupBy("region_id").agg(F.count("*").alias("k")).agg(F.count("*").alias("n_lines"), F.sum("k").alias("n_points"), F.avg("k").alias("mean_points")), "mean_points"), "SELECT count(*) AS n_lines, CAST(sum(k) AS BIGINT) AS n_points, round(avg(k), 6) AS mean_points FROM (SELECT region_id, count(*) AS k FROM sites JOIN regions USING (chr) WHERE position >= start AND position < \"end\" GROUP BY 1)", SITES, REGIONS)

# ---------------------------------------------------------------- batches and order
_BATCHED = "batched AS (SELECT *, (row_number() OVER (PARTITION BY chr ORDER BY position) - 1) // 1000 AS batch FROM sites)"
_on_sites("rechunk", lambda s: ranges.rechunk(s, 1000, WIDTH).select("chr", "position", "batch"), "SELECT chr, position, batch FROM batched", _BATCHED)
_on_sites("batch_extents", lambda s: sites.extents(ranges.rechunk(s, 1000, WIDTH)), "SELECT chr, batch, min(position) AS start, max(position) AS \"end\", count(*) AS n_sites, chr || ':' || min(position) || '-' || max(position) || ' (.)' AS contig FROM batched GROUP BY chr, batch", _BATCHED)
_on_sites("last_batches", lambda s: _last(ranges.rechunk(s, 1000, WIDTH)), "SELECT chr, batch, position FROM batched QUALIFY batch = max(batch) OVER (PARTITION BY chr)", _BATCHED)
_on_sites("overlapping_chunks", lambda s: ranges.overlapping_chunks(s, 1000, 100, WIDTH).select("chr", "position", "chunk", "final"), """, n AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY position) - 1 AS o, count(*) OVER (PARTITION BY chr) AS n FROM sites
), k AS (SELECT *, CASE WHEN n >= 1100 THEN (n - 100) // 1000 ELSE 0 END AS last FROM n)
SELECT chr, position, chunk, chunk = last AS final FROM (SELECT DISTINCT chr, position, last, unnest(list_distinct([least(greatest(CASE WHEN o % 1000 < 100 THEN o // 1000 - 1 ELSE o // 1000 END, 0), last), least(o // 1000, last)])) AS chunk FROM k)""")


def _last(store: DataFrame) -> DataFrame:
    return store.join(store.groupBy("chr").agg(F.max("batch").alias("batch")), ["chr", "batch"], "left_semi").select("chr", "batch", "position")


_on_sites("chr_order_sort", lambda s: ordering.sites_sorted(s, ordering.chr_order(s.sparkSession, ["chr3", "chr1"])).select("chr", "position"), "SELECT chr, position FROM sites WHERE chr IN ('chr3', 'chr1') ORDER BY chr = 'chr1', position")
_add("regions_sorted", lambda spark, d: ordering.regions_sorted(adapter.regions(spark, d), ordering.chr_order(spark, ["chr2", "chr1"])).select("region_id", "chr", "start"), "SELECT region_id, chr, start FROM regions", REGIONS)
_on_sites("batch_index_find", lambda s: _found(ranges.rechunk(s, 1000, WIDTH)), "SELECT chr, batch, start, \"end\" FROM (SELECT chr, batch, min(position) AS start, max(position) AS \"end\" FROM batched GROUP BY 1, 2) WHERE chr = 'chr2' AND start < 60000 AND \"end\" >= 20000", _BATCHED)


def _found(store: DataFrame) -> DataFrame:
    from cytolake.sources.native import find

    return find(sites.extents(store), "chr2", 20_000, 60_000).select("chr", "batch", "start", "end")


# ---------------------------------------------------------------- context
for _mode in ("reference", "biological"):
    _base = f"""{GENOME}, u AS (SELECT chr, translate(sequence, 'cg', 'CG') AS q FROM genome WHERE length(sequence) > 2
), w AS (SELECT chr, i AS p, substr(q, i, 1) AS a, substr(q, i + 1, 1) AS b, substr(q, i + 2, 1) AS c FROM (SELECT chr, q, unnest(range(1, length(q))) AS i FROM u)
)"""
    if _mode == "reference":
        _select = """SELECT DISTINCT chr, position, strand, context FROM (
SELECT chr, p AS position, true AS strand, true AS context FROM w WHERE a = 'C' AND b = 'G' UNION ALL SELECT chr, p + 1, false, true FROM w WHERE a = 'C' AND b = 'G'
UNION ALL SELECT chr, p + 2, false, false FROM w WHERE a = 'C' AND b <> 'C' AND b <> 'G' AND c = 'G'
UNION ALL SELECT chr, p, true, false FROM w WHERE a = 'C' AND b = 'C' AND c = 'G'
UNION ALL SELECT chr, p, true, NULL FROM w WHERE a = 'C' AND b <> 'G' AND c <> 'G' AND c <> ''
UNION ALL SELECT chr, p + 2, false, NULL FROM w WHERE a <> 'C' AND b <> 'C' AND c = 'G')"""
    else:
        _select = """SELECT DISTINCT chr, position, strand, context FROM (
SELECT chr, p AS position, true AS strand, true AS context FROM w WHERE a = 'C' AND b = 'G' UNION ALL SELECT chr, p + 1, false, true FROM w WHERE a = 'C' AND b = 'G'
UNION ALL SELECT chr, p, true, CASE WHEN c = 'G' THEN false END FROM w WHERE a = 'C' AND b <> 'G' AND c <> ''
UNION ALL SELECT chr, p + 2, false, CASE WHEN a = 'C' THEN false END FROM w WHERE c = 'G' AND b <> 'C')"""
    _add(f"context_scan_{_mode}", lambda spark, d, m=_mode: context.scanned(adapter.genome(spark, d), m == "reference"), f"WITH {_base} {_select}")


def _context_join(spark, d):
    s = adapter.sites(spark, d)
    # context rows behind every site, and at those of the forward strand
    grid = s.select("chr", F.explode(F.array(F.when(F.col("strand"), F.col("position")), F.col("position") + 1)).alias("position")).filter("position is not null").distinct()
    return context.aligned(s, grid.withColumn("strand", F.col("position") % 2 == 0).withColumn("context", F.when(F.col("position") % 3 > 0, F.col("position") % 3 == 1)))


_add("context_join", _context_join, """, grid AS (SELECT DISTINCT chr, position FROM (SELECT chr, position FROM sites WHERE strand UNION ALL SELECT chr, position + 1 FROM sites))
SELECT g.chr, g.position, g.position % 2 = 0 AS strand, CASE g.position % 3 WHEN 1 THEN true WHEN 2 THEN false END AS context, coalesce(s.count_m, 0) AS count_m, coalesce(s.count_total, 0) AS count_total, coalesce(s.density, CAST('nan' AS DOUBLE)) AS density
FROM grid g LEFT JOIN sites s ON g.chr = s.chr AND g.position = s.position""", SITES)

# ---------------------------------------------------------------- intervals
_on_sites("region_query", lambda s: intervals.query(s, "chr2", 1_000, 30_000), f"SELECT {_COLUMNS} FROM sites WHERE chr = 'chr2' AND position >= 1000 AND position < 30000")
_add("regions_iterated", lambda spark, d: _r(intervals.in_regions(adapter.sites(spark, d), adapter.regions(spark, d)).groupBy("region_id").agg(F.count("*").alias("n"), F.avg("density").alias("mean")), "mean"), "SELECT region_id, count(*) AS n, round(avg(density), 6) AS mean FROM sites JOIN regions USING (chr) WHERE position >= start AND position < \"end\" GROUP BY 1", SITES, REGIONS)
_on_sites("region_overlap", lambda s: intervals.overlapping(_extents(s), _tiles(s)).select("chr", "batch_a", "tile_b"), """, e AS (SELECT chr, batch, min(position) AS s, max(position) + 1 AS e FROM batched GROUP BY 1, 2), t AS (SELECT DISTINCT chr, position // 5000 AS tile FROM sites)
SELECT e.chr, batch AS batch_a, tile AS tile_b FROM e JOIN t ON e.chr = t.chr AND s < tile * 5000 + 5000 AND e > tile * 5000""", _BATCHED)


def _extents(s: DataFrame) -> DataFrame:
    return sites.extents(ranges.rechunk(s, 1000, WIDTH)).select("chr", "start", (F.col("end") + 1).alias("end"), "batch")


def _tiles(s: DataFrame) -> DataFrame:
    tile = F.floor(F.col("position") / 5000).cast("long")
    return s.select("chr", tile.alias("tile")).distinct().select("chr", (F.col("tile") * 5000).alias("start"), (F.col("tile") * 5000 + 5000).alias("end"), "tile")


_add("semi_join_chromosomes", lambda spark, d: intervals.known_chromosomes(adapter.regions(spark, d), adapter.sites(spark, d)).select("region_id", "chr"), "SELECT region_id, chr FROM regions WHERE chr IN (SELECT chr FROM sites)", SITES, REGIONS)
_add("interval_union_breakpoints", lambda spark, d: intervals.breakpoints(adapter.regions(spark, d)), "SELECT chr, start AS position FROM regions UNION ALL SELECT chr, \"end\" FROM regions", REGIONS)
_add("interval_counts", lambda spark, d: intervals.counts(adapter.regions(spark, d)), "SELECT count(*) AS n_intervals, count(DISTINCT chr) AS n_chr FROM regions", REGIONS)
_add("from_breakpoints", lambda spark, d: intervals.from_breakpoints(intervals.breakpoints(adapter.regions(spark, d)).distinct()), "SELECT chr, coalesce(lag(position) OVER (PARTITION BY chr ORDER BY position), 0) AS start, position AS \"end\" FROM (SELECT chr, start AS position FROM regions UNION SELECT chr, \"end\" FROM regions)", REGIONS)
_add("distance_partition", lambda spark, d: ranges.distance_parts(intervals.breakpoints(adapter.regions(spark, d)).distinct(), 100, width=WIDTH), "SELECT chr, position, CAST(sum(new) OVER (PARTITION BY chr ORDER BY position) AS BIGINT) AS part FROM (SELECT chr, position, CASE WHEN position - lag(position) OVER (PARTITION BY chr ORDER BY position) > 100 THEN 1 ELSE 0 END AS new FROM (SELECT chr, start AS position FROM regions UNION SELECT chr, \"end\" FROM regions))", REGIONS)


def _day_bins(spark: SparkSession, d: str) -> DataFrame:
    """The days of each event type's events."""
    day = F.floor(F.unix_timestamp("ts") / 86400).cast("long")
    days = adapter.table(spark, d, "events").select(F.col("event_type").alias("chr"), day.alias("day")).distinct()
    return days.select("chr", (F.col("day") * 86400).alias("start"), (F.col("day") * 86400 + 86400).alias("end"))


_add("interval_weighted_mean", lambda spark, d: _r(intervals.resampled(adapter.steps(spark, d).withColumn("chr", F.col("sample")), _day_bins(spark, d), 1 << 17), "value"), """, b AS (SELECT DISTINCT event_type AS sample, CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) * 86400 AS start FROM events)
SELECT b.sample AS chr, b.start, b.start + 86400 AS "end", round(coalesce(sum(value * (least(s."end", b.start + 86400) - greatest(s.start, b.start))) / sum(least(s."end", b.start + 86400) - greatest(s.start, b.start)), CAST('nan' AS DOUBLE)), 6) AS value
FROM b LEFT JOIN steps s ON s.sample = b.sample AND s.start < b.start + 86400 AND s."end" > b.start GROUP BY b.sample, b.start""", STEPS)
_add("interval_mean", lambda spark, d: _r(bins.interval_mean(adapter.steps(spark, d).select(F.col("sample").alias("chr"), "start", "end", "value")), "mean"), "SELECT sample AS chr, round(sum(value * (\"end\" - start)) / sum(\"end\" - start), 6) AS mean FROM steps GROUP BY 1", STEPS)

# ---------------------------------------------------------------- order along the chromosome
_on_sites("gap_segments", lambda s: ranges.gap_segments(s, 100, width=WIDTH).groupBy("chr", "segment").agg(F.min("position").alias("start"), F.max("position").alias("end"), F.count("*").alias("n")), "SELECT chr, segment, min(position) AS start, max(position) AS \"end\", count(*) AS n FROM (SELECT chr, position, CAST(sum(new) OVER (PARTITION BY chr ORDER BY position) AS BIGINT) AS segment FROM (SELECT chr, position, CASE WHEN position - lag(position) OVER (PARTITION BY chr ORDER BY position) >= 100 THEN 1 ELSE 0 END AS new FROM sites)) GROUP BY 1, 2")
_on_sites("cumulative_counts", lambda s: ranges.cumulative_counts(s, WIDTH).select("chr", "position", "cum_m", "cum_total"), "SELECT chr, position, CAST(sum(count_m) OVER w AS BIGINT) AS cum_m, CAST(sum(count_total) OVER w AS BIGINT) AS cum_total FROM sites WINDOW w AS (PARTITION BY chr ORDER BY position)")
_add("sortedness_violations", lambda spark, d: sites.order_violations(adapter.regions(spark, d).select("chr", F.col("start").alias("position"), (F.col("region_id") * 7919 % 104729).alias("o")), "o"), "SELECT chr, CAST(count(*) FILTER (WHERE p < b) AS BIGINT) AS unsorted, CAST(count(*) FILTER (WHERE p = b) AS BIGINT) AS repeated FROM (SELECT chr, start AS p, lag(start) OVER (PARTITION BY chr ORDER BY region_id * 7919 % 104729) AS b FROM regions) GROUP BY chr", REGIONS)
_add("duplicate_positions", lambda spark, d: sites.check(adapter.samples(spark, d)), "SELECT CAST(count(*) FILTER (WHERE chr IS NULL) AS BIGINT) AS null_chr, CAST(count(*) FILTER (WHERE position IS NULL) AS BIGINT) AS null_position, count(DISTINCT chr) - 1 AS extra_chromosomes, count(*) - count(DISTINCT (chr, position)) AS repeated_positions FROM samples", SAMPLES)
SQL["duplicate_positions"] = SQL["duplicate_positions"].replace("count(DISTINCT chr) - 1 AS extra_chromosomes", "CAST(0 AS BIGINT) AS extra_chromosomes")

# ---------------------------------------------------------------- scalars
_TAIL = "CASE WHEN count_total = 0 THEN CAST('nan' AS DOUBLE) WHEN count_m = 0 THEN 1 WHEN count_m = count_total THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, count_m + 1), lambda k: exp(lgamma(count_total + 1) - lgamma(k + 1) - lgamma(count_total - k + 1) + k * ln(0.3) + (count_total - k) * ln(0.7))))) END"
_on_sites("binom_pvalue", lambda s: s.select("chr", "position", F.round(scalar.binomial_tail(F.col("count_m"), F.col("count_total"), 0.3), 6).alias("p")), f"SELECT chr, position, round({_TAIL}, 6) AS p FROM sites")
_on_sites("binom_binarize", lambda s: sites.binarized(s, 0.3, 0.05).select("chr", "position", "count_m", "count_total", "density"), f"SELECT chr, position, CAST(CASE WHEN p <= 0.05 THEN 1 ELSE 0 END AS BIGINT) AS count_m, CAST(1 AS BIGINT) AS count_total, CASE WHEN p <= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS density FROM (SELECT chr, position, {_TAIL} AS p FROM sites)")
_add("contig_functions", lambda spark, d: _contigs(adapter.regions(spark, d)), "SELECT region_id, chr || ':' || start || '-' || \"end\" || ' (.)' AS text, \"end\" - start AS length, greatest(0, start - 500) AS up, least(4294967295, \"end\" + 500) AS down, start >= 1000 AND \"end\" <= 50000 AND chr = 'chr1' AS inside FROM regions", REGIONS)


def _contigs(r: DataFrame) -> DataFrame:
    c = scalar.contig(F.col("chr"), F.col("start"), F.col("end"))
    outer = scalar.contig(F.lit("chr1"), F.lit(1000), F.lit(50_000))
    return r.select("region_id", scalar.contig_text(c).alias("text"), scalar.contig_length(c).alias("length"), scalar.extend_upstream(c, 500)["start"].alias("up"), scalar.extend_downstream(c, 500)["end"].alias("down"), scalar.is_in(c, outer).alias("inside"))


_add("contig_bounds", lambda spark, d: _bounds(adapter.regions(spark, d)), "SELECT region_id, start + 7 AS moved, \"end\" - 7 AS cut, start = 0 AND \"end\" = 0 AS nothing, CASE WHEN chr <> 'chr1' THEN NULL WHEN start = 1000 AND \"end\" = 50000 THEN 0 WHEN \"end\" <= 1000 THEN -1 WHEN start >= 50000 THEN 1 END AS side FROM regions", REGIONS)
_add("position_functions", lambda spark, d: _positions(adapter.sites(spark, d)), "SELECT chr, position, chr || ':' || position AS text, CASE WHEN position >= 500 THEN position - 500 END AS back, position + 30 AS ahead, CASE WHEN chr = 'chr1' THEN position + 100 END AS added, CASE WHEN chr = 'chr1' AND position >= 100 THEN position - 100 END AS taken, chr = '' AND position = 0 AS nothing FROM sites", SITES)


def _bounds(r: DataFrame) -> DataFrame:
    c = scalar.contig(F.col("chr"), F.col("start"), F.col("end"))
    other = scalar.contig(F.lit("chr1"), F.lit(1000), F.lit(50_000))
    return r.select("region_id", scalar.set_start(c, F.col("start") + 7)["start"].alias("moved"), scalar.set_end(c, F.col("end") - 7)["end"].alias("cut"), scalar.is_empty(c).alias("nothing"), scalar.contig_order(c, other).alias("side"))


def _positions(s: DataFrame) -> DataFrame:
    at = lambda c, p: F.struct(c.alias("seqname"), p.cast("long").alias("position"))
    p, other = at(F.col("chr"), F.col("position")), at(F.lit("chr1"), F.lit(100))
    return s.select("chr", "position", scalar.position_text(F.col("chr"), F.col("position")).alias("text"), scalar.shift_position(p, -500)["position"].alias("back"), scalar.shift_position(p, 30)["position"].alias("ahead"), scalar.add_positions(p, other)["position"].alias("added"), scalar.subtract_positions(p, other)["position"].alias("taken"), scalar.is_zero(p).alias("nothing"))


_add("pearson", lambda spark, d: _r(pvalues.pearson(adapter.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), "r"), "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")

# ---------------------------------------------------------------- tests
_TESTED = "tested AS (SELECT event_type, user_id % 2 = 0 AS f, round(value, 1) AS v FROM events WHERE value IS NOT NULL)"
_MWU = """, t AS (SELECT event_type, v, count(*) AS t, count(*) FILTER (WHERE f) AS t1 FROM tested GROUP BY 1, 2
), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS r FROM t
), s AS (SELECT event_type, CAST(sum(t1) AS BIGINT) AS n1, CAST(sum(t - t1) AS BIGINT) AS n2, sum(r * t1)::DOUBLE AS r1, sum(t::DOUBLE * t * t - t) AS ties FROM r GROUP BY 1
), u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0))::DOUBLE AS u, n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1))) AS var FROM s)
SELECT event_type, n1, n2, round(u, 6) AS u, round((u - n1 * n2 / 2.0 + 0.5) / sqrt(var), 6) AS z FROM u"""


def _events(spark, d):
    return adapter.table(spark, d, "events").select("event_type", (F.col("user_id") % 2 == 0).alias("f"), F.round("value", 1).alias("v"))


_add("mwu_statistic", lambda spark, d: _r(pvalues.mann_whitney(_events(spark, d), "v", F.col("f"), "event_type"), "u", "z"), _MWU, _TESTED)
# erf(x) = exp(-x * x) * sum of x ** (2 n + 1) / gamma(n + 3/2)
_ERFC = "greatest(0, CASE WHEN x = 0 THEN 1 ELSE 1 - exp(-x * x) * list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln(x) - lgamma(n + 1.5)))) END)"
_add("mwu_pvalue", lambda spark, d: _r(pvalues.mann_whitney_p(_events(spark, d), "v", F.col("f"), "event_type"), "u", "z", "p"), _MWU.replace("SELECT event_type, n1, n2, round(u, 6) AS u,", ", z AS (SELECT event_type, n1, n2, round(u, 6) AS u, (u - n1 * n2 / 2.0 + 0.5) / sqrt(var) AS raw,") + f") SELECT event_type, n1, n2, u, z, round({_ERFC}, 6) AS p FROM (SELECT *, abs(raw) / sqrt(2) AS x FROM z)", _TESTED)
# values 8e-7 apart: the third is tied with the second only where there is no first
_NEAR = """raw AS (SELECT event_type, user_id // 5 % 2 = 0 AS f, round(value, 1) AS base, user_id % 3 AS k FROM events WHERE value IS NOT NULL
), tested AS (SELECT event_type, f, base + CASE WHEN k = 2 AND min(k) OVER (PARTITION BY event_type, base) <> 1 THEN 0.001 ELSE 0 END AS v FROM raw)"""
_add("mwu_near_ties", lambda spark, d: _r(pvalues.mann_whitney(_near_events(spark, d), "v", F.col("f"), "event_type"), "u", "z"), _MWU, _NEAR)


def _near_events(spark, d):
    return adapter.table(spark, d, "events").select("event_type", (F.floor(F.col("user_id") / 5) % 2 == 0).alias("f"), (F.round("value", 1) + (F.col("user_id") % 3) * F.lit(8e-7)).alias("v"))


_P = "p AS (SELECT o_orderkey AS k, (o_orderkey * 7919 % 99991 + 1) / 100000.0::DOUBLE AS p_value FROM orders)"


def _pvalues(spark, d):
    return adapter.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") * 7919 % 99991 + 1) / 100000.0).alias("p_value"))


_RANKED = ", r AS (SELECT *, row_number() OVER (ORDER BY p_value, k) AS i, count(*) OVER () AS n FROM p)"
_add("padj_bh", lambda spark, d: _r(pvalues.adjusted(_pvalues(spark, d), key="k"), "p_value", "padj"), _RANKED + " SELECT k, round(p_value, 6) AS p_value, round(least(1, min(p_value * n / i) OVER (ORDER BY i DESC)), 6) AS padj FROM r", _P)
_add("padj_by", lambda spark, d: _r(pvalues.adjusted(_pvalues(spark, d), method="by", key="k"), "p_value", "padj"), _RANKED + ", h AS (SELECT sum(1.0::DOUBLE / i) AS h FROM r) SELECT k, round(p_value, 6) AS p_value, round(least(1, min(p_value * n / i * h) OVER (ORDER BY i DESC)), 6) AS padj FROM r, h", _P)
_add("padj_bonferroni", lambda spark, d: _r(pvalues.adjusted(_pvalues(spark, d), method="bonf"), "p_value", "padj"), "SELECT k, round(p_value, 6) AS p_value, round(least(1, p_value * count(*) OVER ()), 6) AS padj FROM p", _P)

# ---------------------------------------------------------------- validation
_BATCHED_SAMPLES = "batched AS (SELECT *, position // 5000 AS batch FROM samples)"


def _batched(spark, d):
    return adapter.samples(spark, d).withColumn("batch", F.floor(F.col("position") / 5000).cast("long"))


_add("validate_consistency", lambda spark, d: validate.disagreements(_batched(spark, d)).drop("n_digests"), """, s AS (SELECT sample, chr, batch, min(position) || '-' || max(position) AS c, count(*) AS n FROM batched GROUP BY 1, 2, 3), g AS (SELECT chr, batch, count(*) AS n_samples, count(DISTINCT c) AS n_contigs, count(DISTINCT n) AS n_sizes FROM s GROUP BY 1, 2)
SELECT * FROM g WHERE n_samples <> (SELECT count(DISTINCT sample) FROM samples) OR n_contigs > 1 OR n_sizes > 1""", SAMPLES, _BATCHED_SAMPLES)
_add("deep_validate", lambda spark, d: validate.disagreements(_batched(spark, d), deep=True).select("chr", "batch", "n_samples", "n_contigs", "n_sizes", "n_digests"), """, s AS (SELECT sample, chr, batch, min(position) || '-' || max(position) AS c, count(*) AS n, list(position ORDER BY position) AS p FROM batched GROUP BY 1, 2, 3), g AS (SELECT chr, batch, count(*) AS n_samples, count(DISTINCT c) AS n_contigs, count(DISTINCT n) AS n_sizes, count(DISTINCT p) AS n_digests FROM s GROUP BY 1, 2)
SELECT * FROM g WHERE n_samples <> (SELECT count(DISTINCT sample) FROM samples) OR n_contigs > 1 OR n_sizes > 1 OR n_digests > 1""", SAMPLES, _BATCHED_SAMPLES)
_add("majority_block_counts", lambda spark, d: validate.block_counts(_batched(spark, d)), """, b AS (SELECT sample, count(DISTINCT (chr, batch)) AS n_blocks FROM batched GROUP BY 1), g AS (SELECT n_blocks, count(*) AS n, list(sample ORDER BY sample) AS members FROM b GROUP BY 1)
SELECT n_blocks, n, members, n_blocks = (SELECT n_blocks FROM g ORDER BY n DESC, n_blocks LIMIT 1) AS majority FROM g""", SAMPLES, _BATCHED_SAMPLES)
_add("overlapping_batches", lambda spark, d: sites.overlapping_batches(adapter.samples(spark, d).withColumn("batch", F.floor((F.col("position") + F.col("sample") * 100) / 5000).cast("long"))), """, e AS (SELECT chr, (position + sample * 100) // 5000 AS batch, min(position) AS first, max(position) AS last FROM samples GROUP BY 1, 2), b AS (SELECT *, max(last) OVER (PARTITION BY chr ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_last FROM e)
SELECT chr, batch, previous_last, first FROM b WHERE first <= previous_last""", SAMPLES)

# ---------------------------------------------------------------- annotation
_GFF = """concat('ID=n', n_nationkey, ';Name=', n_name, ';Parent=r', n_regionkey, ';Alias=a', n_nationkey, ',b', n_nationkey, ';custom=', n_regionkey, ';')"""


def _gff(spark, d):
    text = F.concat(F.lit("ID=n"), F.col("n_nationkey"), F.lit(";Name="), F.col("n_name"), F.lit(";Parent=r"), F.col("n_regionkey"), F.lit(";Alias=a"), F.col("n_nationkey"), F.lit(",b"), F.col("n_nationkey"), F.lit(";custom="), F.col("n_regionkey"), F.lit(";"))
    nations = adapter.table(spark, d, "nation").select(F.lit("chr1").alias("seqid"), F.lit("t").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, "gene").otherwise("exon").alias("feature_type"), (F.col("n_nationkey") * 1000).cast("long").alias("start"), (F.col("n_nationkey") * 1000 + 300).cast("long").alias("end"), F.lit(None).cast("double").alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("int").alias("phase"), text.alias("attributes"))
    regions = adapter.table(spark, d, "region").select(F.lit("chr1").alias("seqid"), F.lit("t").alias("source"), F.lit("region").alias("feature_type"), F.lit(0).cast("long").alias("start"), F.lit(100_000).cast("long").alias("end"), F.lit(None).cast("double").alias("score"), F.lit("-").alias("strand"), F.lit(None).cast("int").alias("phase"), F.concat(F.lit("ID=r"), F.col("r_regionkey")).alias("attributes"))
    return annotation.entries(nations.unionByName(regions))


_add("gff_parse", lambda spark, d: _gff(spark, d).filter("feature_type <> 'region'").select("id", F.col("attributes.name")[0].alias("name"), F.col("attributes.parent")[0].alias("parent"), F.col("attributes.alias").alias("alias"), F.col("attributes.other")["custom"].alias("custom")), "SELECT 'n' || n_nationkey AS id, n_name AS name, 'r' || n_regionkey AS parent, ['a' || n_nationkey, 'b' || n_nationkey] AS alias, CAST(n_regionkey AS VARCHAR) AS custom FROM nation")
_add("gff_serialize", lambda spark, d: _gff(spark, d).filter("feature_type <> 'region'").select("id", gff.attributes_text(F.col("attributes")).alias("text")), "SELECT 'n' || n_nationkey AS id, concat('ID=n', n_nationkey, ';Name=', n_name, ';Alias=a', n_nationkey, ',b', n_nationkey, ';Parent=r', n_regionkey, ';custom=', n_regionkey) AS text FROM nation")
_add("annotation_parents", lambda spark, d: annotation.with_parents(_gff(spark, d)).select("id", "parent_id", "parent_start", "parent_end"), "SELECT 'n' || n_nationkey AS id, 'r' || r_regionkey AS parent_id, CASE WHEN r_regionkey IS NOT NULL THEN 0::BIGINT END AS parent_start, CASE WHEN r_regionkey IS NOT NULL THEN 100000::BIGINT END AS parent_end FROM nation LEFT JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, NULL, NULL, NULL FROM region")
_EDGES = "edges AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey > 0 THEN 'r' || (r_regionkey - 1) ELSE 'world' END FROM region)"


def _edges(spark, d):
    n = adapter.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    r = F.col("r_regionkey")
    return n.unionByName(adapter.table(spark, d, "region").select(F.concat(F.lit("r"), r).alias("id"), F.when(r > 0, F.concat(F.lit("r"), r - 1)).otherwise("world").alias("parent")))


_add("annotation_children", lambda spark, d: annotation.children(_edges(spark, d)), "SELECT parent, list(id ORDER BY id) AS children FROM edges GROUP BY parent", _EDGES)
_add("orphan_parents", lambda spark, d: annotation.orphans(_edges(spark, d)), "SELECT id, parent FROM edges WHERE parent NOT IN (SELECT id FROM edges)", _EDGES)
_add("subtree_removal", lambda spark, d: annotation.without_subtree(_edges(spark, d), "r2"), "WITH RECURSIVE " + _EDGES + ", gone AS (SELECT 'r2' AS id UNION SELECT edges.id FROM edges JOIN gone ON edges.parent = gone.id) SELECT id, parent FROM edges WHERE id NOT IN (SELECT id FROM gone)")
_add("flanks", lambda spark, d: annotation.flanks(_gff(spark, d), 100, F.col("feature_type") == "gene").unionByName(annotation.flanks(_gff(spark, d), -100, F.col("feature_type") == "gene")).drop("strand"), "SELECT 'n' || n_nationkey || '_flank_' || f AS id, 'chr1' AS chr, CASE WHEN f > 0 THEN n_nationkey * 1000 + 300 ELSE greatest(0, n_nationkey * 1000 - 100) END::BIGINT AS start, CASE WHEN f > 0 THEN n_nationkey * 1000 + 400 ELSE n_nationkey * 1000 END::BIGINT AS \"end\", 'flank_gene' AS feature_type, 'n' || n_nationkey AS parent FROM nation, (VALUES (100), (-100)) t(f) WHERE n_nationkey % 2 = 0")
_add("regex_entries", lambda spark, d: annotation.matching(_gff(spark, d), "^n1\\d$").select("id"), "SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey BETWEEN 10 AND 19")
_add("feature_types", lambda spark, d: annotation.by_type(_gff(spark, d)), "SELECT feature_type, list(id ORDER BY id) AS ids FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'gene' ELSE 'exon' END AS feature_type, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'region', 'r' || r_regionkey FROM region) GROUP BY 1")

_add("file_gff", lambda spark, d: trips.gff(spark, d, _gff(spark, d)), "SELECT 'n' || n_nationkey AS id, 'chr1' AS chr, CASE WHEN n_nationkey % 2 = 0 THEN 'gene' ELSE 'exon' END AS feature_type, (n_nationkey * 1000)::BIGINT AS start, (n_nationkey * 1000 + 300)::BIGINT AS \"end\", true AS strand, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'chr1', 'region', 0, 100000, false, NULL FROM region")
trips.register(_add)

# ---------------------------------------------------------------- algorithms and pipelines
_O = dmr.Options(context="CG", n_missing=2, min_coverage=0, min_cytosines=3, padj=1.0, diff_threshold=0.05)


def _dmr(spark, d):
    return dmr.regions(adapter.samples(spark, d), F.col("sample") < 2, F.col("sample") >= 2, 2, 2, _O, WIDTH)


_on_sites("pelt_segments", lambda s: _r(dimred.change_points(s, width=WIDTH), "density"))
_add("dmr_segments", lambda spark, d: _r(_dmr(spark, d), "p_value", "meth_a", "meth_b", "meth_diff", "meth_mean"))
_add("dmr_filtered", lambda spark, d: _r(dmr.filtered(_dmr(spark, d), _O), "p_value", "padj", "meth_a", "meth_b", "meth_diff", "meth_mean"))
_add("dimred_shrink", lambda spark, d: _r(dimred.shrink(adapter.samples(spark, d), coverage=5, width=WIDTH), "value"))
_on_sites("shrunken_batches", lambda s: _r(bins.shrunken(dimred.segmented(s, width=WIDTH)), "value"))
_PARTS = """), b AS (SELECT * FROM (SELECT lag(p) OVER (ORDER BY p) AS start, p AS "end" FROM p) WHERE start IS NOT NULL
), n AS (SELECT DISTINCT sample FROM steps)
SELECT n.sample, 't' AS chr, b.start, b."end", round(coalesce(sum(value * (least(s."end", b."end") - greatest(s.start, b.start))) / sum(least(s."end", b."end") - greatest(s.start, b.start)), CAST('nan' AS DOUBLE)), 6) AS value
FROM n CROSS JOIN b LEFT JOIN steps s ON s.sample = n.sample AND s.start < b."end" AND s."end" > b.start GROUP BY n.sample, b.start, b."end\""""
_add("dimred_merge_full", lambda spark, d: _r(dimred.merge(adapter.steps(spark, d), width=1 << 20), "value"), ", p AS (SELECT start AS p FROM steps UNION SELECT \"end\" FROM steps" + _PARTS, STEPS)
_add("dimred_merge_dbscan", lambda spark, d: _r(dimred.merge(adapter.steps(spark, d), dimred.MergeType("dbscan", 600.0, 2, 3600, "mean"), 1 << 20), "value"), """, one AS (SELECT p, count(*) AS n FROM (SELECT start AS p FROM steps UNION ALL SELECT "end" FROM steps) GROUP BY p
), near AS (SELECT *, sum(n) OVER (ORDER BY p RANGE BETWEEN 599 PRECEDING AND 599 FOLLOWING) AS m FROM one
), cores AS (SELECT *, sum(new) OVER (ORDER BY p) AS g FROM (SELECT *, CASE WHEN p - lag(p) OVER (ORDER BY p) >= 600 THEN 1 ELSE 0 END AS new FROM near WHERE m >= 2)
), p AS (SELECT DISTINCT CAST(round(sum(p * n)::DOUBLE / sum(n)) AS BIGINT) AS p FROM cores GROUP BY g""" + _PARTS, STEPS)
_add("stitched_points", lambda spark, d: _r(dimred.stitched(adapter.steps(spark, d).select("chr", F.col("end").alias("position"), F.col("value").alias("density")), 60, 1 << 20), "density"), """, one AS (SELECT "end" AS p, sum(value) AS v, count(*) AS n FROM steps GROUP BY 1), g AS (SELECT *, sum(new) OVER (ORDER BY p) AS part FROM (SELECT *, CASE WHEN p - lag(p) OVER (ORDER BY p) > 60 THEN 1 ELSE 0 END AS new FROM one))
SELECT 't' AS chr, max(p) AS position, round(sum(v) / sum(n), 6) AS density FROM g GROUP BY part""", STEPS)
_add("dimred_summary", lambda spark, d: _r(dimred.summary(adapter.sites(spark, d), intervals.breakpoints(adapter.regions(spark, d)).distinct()), "ratio"), "SELECT cytosines, changepoints, round(100.0::DOUBLE * changepoints / cytosines, 6) AS ratio FROM (SELECT (SELECT count(*) FROM sites) AS cytosines, (SELECT count(*) FROM (SELECT chr, start FROM regions UNION SELECT chr, \"end\" FROM regions)) AS changepoints)", SITES, REGIONS)
_add("windowed_events", lambda spark, d: _r(_windows(spark, d), "mean_value"), "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")


def _windows(spark, d):
    from cytolake.streaming.ingest import coverage_by_window

    return coverage_by_window(adapter.table(spark, d, "events"), "ts")
