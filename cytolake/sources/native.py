"""The native store: Parquet, a folder per chromosome, sorted by position, so that scans prune by both. The order of
chromosomes, where one is given, lies in the store's folder _order, which scans of the store pass over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.operators.ranges import rechunk
from cytolake.operators.sites import extents
from cytolake.schema import SITE_COLUMNS


def write(sites: DataFrame, path: str, chunk: int = 10_000, order: DataFrame | None = None, codec: str = "zstd", range_width: int = 1 << 22) -> None:
    """Sites with batch numbers. Rows are dealt by ranges of position, so a long chromosome has many writers; order
    (chr, ord) leaves out other chromosomes and is kept with the store."""
    rows = sites if order is None else sites.join(order.select("chr"), "chr", "left_semi")
    rows = rechunk(rows, chunk).withColumn("_range", F.floor(F.col("position") / range_width))
    rows.repartition("chr", "_range").sortWithinPartitions("chr", "position").drop("_range").write.mode("overwrite").partitionBy("chr").option("compression", codec).parquet(path)
    if order is not None:
        ranked = order if "ord" in order.columns else order.withColumn("ord", F.row_number().over(Window.orderBy("chr")).cast("long"))
        ranked.select("chr", "ord").coalesce(1).write.mode("overwrite").parquet(f"{path}/_order")


def read_order(spark: SparkSession, path: str) -> DataFrame | None:
    """(chr, ord) as the store keeps it; None for a store without an order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_order")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("chr string, ord long").parquet(f"{path}/_order")


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows in its own order of chromosomes (by name, if it keeps none) and by position."""
    rows, order = read(spark, path), read_order(spark, path)
    return rows.orderBy("chr", "position") if order is None else rows.join(order, "chr").orderBy("ord", "position").drop("ord")


def nth(store: DataFrame, number: int) -> DataFrame:
    """Rows of the store's batch number so many (from 0), batches taken by chromosome and then by their own number."""
    index = store.select("chr", "batch").distinct()
    # batches per chromosome, and a running sum over chromosomes: two small tables
    per = index.groupBy("chr").agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chosen = index.join(per, "chr").filter(F.lit(number) == F.col("before") + F.col("batch")).select("chr", "batch")
    return store.join(chosen, ["chr", "batch"], "left_semi")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("position long, strand boolean, context boolean, count_m long, count_total long, density double, batch long, chr string").parquet(path).select(*SITE_COLUMNS, "batch")


def batches(store: DataFrame, *numbers: int) -> DataFrame:
    """Rows of the batches with these numbers on every chromosome."""
    return store.filter(F.col("batch").isin(*numbers))


def blocks_total(store: DataFrame) -> int:
    return store.select("chr", "batch").distinct().count()


def last_batches(store: DataFrame) -> DataFrame:
    """Rows of each chromosome's last batch."""
    return store.join(store.groupBy("chr").agg(F.max("batch").alias("batch")), ["chr", "batch"], "left_semi")


def write_index(store: DataFrame, path: str) -> None:
    extents(store).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(index: DataFrame, chr: str, start: int, end: int) -> DataFrame:  # noqa: A002
    """Batches of the index that overlap a region; extents include their ends."""
    return index.filter((F.col("chr") == chr) & (F.col("start") < end) & (F.col("end") >= start))
