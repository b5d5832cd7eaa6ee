"""Methylation tables over the driver's star schema, and the same as SQL.

sites: order lines summed by (order, line number), the order number as chromosome and position. samples: the same with
the supplier's remainder as replicate. regions: one for each order. genome: the documents' texts as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.functions.scalar import density
from cytolake.schema import SITE_COLUMNS

#: Range width for windows over these tables' positions.
WIDTH = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sites(lines: DataFrame, *extra) -> DataFrame:
    flag = F.min("l_returnflag")
    m = F.sum(F.floor(F.col("l_quantity") * F.col("l_discount") * 10).cast("int")).cast("long")
    rows = lines.groupBy("l_orderkey", "l_linenumber", *extra).agg((F.min("l_linestatus") == "O").alias("strand"), F.when(flag == "A", True).when(flag == "N", False).alias("context"), m.alias("count_m"), F.sum(F.col("l_quantity").cast("int")).cast("long").alias("count_total"))
    rows = rows.withColumn("chr", F.concat(F.lit("chr"), (F.col("l_orderkey") % 5 + 1).cast("string"))).withColumn("position", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return rows.withColumn("density", density(F.col("count_m"), F.col("count_total")))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(table(spark, sf_dir, "lineitem")).select(*SITE_COLUMNS)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of four replicates."""
    return _sites(table(spark, sf_dir, "lineitem").withColumn("sample", F.col("l_suppkey") % 4), "sample").select(*SITE_COLUMNS, "sample")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of 800 positions from each order on: (region_id, chr, start, end)."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(o.alias("region_id"), F.concat(F.lit("chr"), (o % 5 + 1).cast("string")).alias("chr"), (o * 8).alias("start"), (o * 8 + 800).alias("end"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chr"), F.coalesce("text", F.lit("")).alias("sequence"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step function per event type: (sample, chr, start, end, value) from the seconds of its events."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").groupBy("event_type", F.unix_timestamp("ts").alias("end")).agg(F.avg("value").alias("value"))
    before = F.lag("end").over(Window.partitionBy("event_type").orderBy("end"))
    rows = e.select(F.col("event_type").alias("sample"), F.lit("t").alias("chr"), before.alias("start"), "end", F.round("value", 6).alias("value"))
    return rows.filter("start is not null")


SITES = """sites AS (
  SELECT 'chr' || CAST(l_orderkey % 5 + 1 AS VARCHAR) AS chr, l_orderkey * 8 + l_linenumber AS position, min(l_linestatus) = 'O' AS strand,
    CASE min(l_returnflag) WHEN 'A' THEN true WHEN 'N' THEN false END AS context,
    CAST(sum(CAST(floor(l_quantity * l_discount * 10) AS INT)) AS BIGINT) AS count_m, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS count_total,
    CASE WHEN sum(CAST(l_quantity AS INT)) = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(sum(CAST(floor(l_quantity * l_discount * 10) AS INT)) AS DOUBLE) / sum(CAST(l_quantity AS INT)) END AS density
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
SAMPLES = SITES.replace("sites AS (", "samples AS (").replace("FROM lineitem GROUP BY l_orderkey, l_linenumber", "FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey % 4").replace("AS density\n", "AS density, l_suppkey % 4 AS sample\n")
REGIONS = "regions AS (SELECT o_orderkey AS region_id, 'chr' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS chr, o_orderkey * 8 AS start, o_orderkey * 8 + 800 AS \"end\" FROM orders)"
GENOME = "genome AS (SELECT CAST(doc_id AS VARCHAR) AS chr, coalesce(text, '') AS sequence FROM documents)"
STEPS = """steps AS (
  SELECT * FROM (SELECT event_type AS sample, 't' AS chr, lag(e) OVER (PARTITION BY event_type ORDER BY e) AS start, e AS "end", round(v, 6) AS value
    FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS e, avg(value) AS v FROM events GROUP BY 1, 2)) WHERE start IS NOT NULL)"""
