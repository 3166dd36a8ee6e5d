"""Status changes of postings, appended, and the current status over them.

The log is partitioned by a hash bucket of the posting and by batch. A batch writes one file in each bucket that one of its
postings falls into and rewrites nothing; repeated, it writes its own partitions over. The current status is
the last change of a posting, a maximum, so it doesn't matter if a change lies there twice. ``compact_statuses`` folds the batches of
the buckets that have many into one base partition of the bucket; all other buckets stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.sources.tables import KEY, drop_partition, read_table, rewrite_partitions

CHANGES = "profile string, id string, new_status string, changed_at timestamp, change_id long, bucket int, batch long"
PARTITIONS = ["bucket", "batch"]
BASE = -1  # the batch number of what has been folded
BUCKETS = 64


def last_changes(changes: DataFrame, *also: str) -> DataFrame:
    """The last change per posting, by time, then by number; combined before the shuffle."""
    row = F.max_by(F.struct("new_status", "changed_at", "change_id"), F.struct("changed_at", "change_id", "new_status"))
    return changes.groupBy(*KEY, *also).agg(row.alias("r")).select(*KEY, *also, "r.*")


def append_changes(changes: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """One batch of changes (profile, id, new_status, changed_at, change_id); ``buckets`` stays the same for a log."""
    if batch < 0:
        raise ValueError("batches are numbered from 0")
    rows = last_changes(changes).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")).withColumn("batch", F.lit(batch).cast("long"))
    rows = rows.select(*[f.split()[0] for f in CHANGES.split(", ")]).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def current_statuses(spark: SparkSession, path: str) -> DataFrame:
    """(profile, id, status, changed_at) of every posting with a change."""
    last = last_changes(read_table(spark, path, CHANGES))
    return last.select(*KEY, F.col("new_status").alias("status"), "changed_at")


def compact_statuses(spark: SparkSession, path: str, least: int = 8) -> list[int]:
    """Folds the buckets that hold ``least`` batches or more beside their base; returns which.

    The new base is written before the folded batches go. After a failure in between they are only there twice.
    """
    log = read_table(spark, path, CHANGES)
    batches = log.where(F.col("batch") != BASE).select(*PARTITIONS).distinct()
    full = [r["bucket"] for r in batches.groupBy("bucket").count().where(F.col("count") >= least).collect()]  # at most one row a bucket
    if not full:
        return []
    rows = log.where(F.col("bucket").isin(full))
    folded = [(r["bucket"], r["batch"]) for r in batches.where(F.col("bucket").isin(full)).collect()]  # partition values
    base = last_changes(rows, "bucket").select(*KEY, "new_status", "changed_at", "change_id", "bucket", F.lit(BASE).cast("long").alias("batch")).repartition("bucket")
    rewrite_partitions(base, path, PARTITIONS)
    for bucket, batch in folded:
        drop_partition(spark, path, {"bucket": bucket, "batch": batch})
    return sorted(full)
