"""Reports as a stream of files: new files become sites of a store, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cytolake.config import report_type
from cytolake.operators.sites import FROM_REPORT, cast


def stream_sites(spark: SparkSession, folder: str, kind: str, files_per_trigger: int = 100) -> DataFrame:
    """The sites of the reports that appear in a folder. Header lines of BedGraph files fail the position and go."""
    r = report_type(kind)
    rows = spark.readStream.schema(r.schema).option("sep", "\t").option("quote", "").option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return cast(FROM_REPORT[r.name](rows.filter(F.col(r.position).isNotNull()) if r.skip else rows))


def append(spark: SparkSession, folder: str, kind: str, store: str, checkpoint: str, batch_width: int = 1_000_000) -> StreamingQuery:
    """Run over what is there, then stop; the file sink's log makes a rerun after a failure harmless. A stream cannot
    count the rows before one, so a store's batches are ranges of batch_width positions."""
    sites = stream_sites(spark, folder, kind).withColumn("batch", F.floor(F.col("position") / batch_width).cast("long"))
    return sites.writeStream.format("parquet").partitionBy("chr").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_by_window(events: DataFrame, time: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means of value per tumbling window of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")
