"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a temporary folder if all runs in one process (master
    local); on a cluster an error, as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cytolake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def existing(spark: SparkSession, *paths: str) -> None:
    """An error unless every path or glob names something, and there is one at all."""
    if not paths:
        raise ValueError("no paths")
    for p in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
        if found is None or not len(found):
            raise FileNotFoundError(p)
