"""The folder for what a job writes between its steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which all executors share; where it is unset, a folder of our own in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="xylem-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Batches for Python of 8 MB at most, however long texts are; a lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name, None)
    if have is None or not have.isdigit() or not 0 < int(have) <= 8_000_000:
        spark.conf.set(name, "8000000")


def spread(spark: SparkSession, *paths: str) -> None:
    """Shuffles begin with a partition for each 4 MB of what is stored at the paths, so that tasks don't grow with the input. Spark puts small ones together again; a higher setting of the session stays."""
    at, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    size = sum(at(p).getFileSystem(conf).getContentSummary(at(p)).getLength() for p in paths)
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    have = spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if size // 4_000_000 > int(have):
        spark.conf.set(name, str(min(size // 4_000_000, 4_000)))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
