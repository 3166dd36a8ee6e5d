"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "siftwork", cores: int | str = "*", **overrides: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    local = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("SIFTWORK_DRIVER_MEMORY", "8g"),
    }
    for key, value in {**SETTINGS, **local, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """A small scan over all cores.

    Text work is paid per byte, and a file with one row group is one task however many cores
    wait. A scan with two splits per core or more, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="siftwork-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path
