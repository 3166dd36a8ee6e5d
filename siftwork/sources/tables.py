"""Writing postings, scores, chunks and status changes to Parquet tables.

The first part is pure: DataFrames in, DataFrames out. The second part writes. Parquet has
no MERGE, so a change rewrites the touched partitions: the new content is written to the
shared folder first and from there over the old partitions, never while they are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from siftwork import vocab
from siftwork.session import shared_dir


# ---- changes as DataFrames -----------------------------------------------------------------


def first_arrivals(new: DataFrame, keys: list[str], order: str = "arrival") -> DataFrame:
    """One row per key, the first to arrive. Combined before the shuffle, so a key that holds
    most of a batch stays cheap; rows that arrive together are told apart by their content."""
    others = [c for c in new.columns if c not in keys]
    row = F.min_by(F.struct(*others), F.struct(F.col(order).alias("order"), F.xxhash64(*others).alias("tie")))
    return new.groupBy(*keys).agg(row.alias("r")).select(*keys, "r.*").select(*new.columns)


def insert_or_ignore(new: DataFrame, target: DataFrame, keys: list[str], order: str = "arrival") -> DataFrame:
    """Rows of ``new`` to append: first arrival per key, keys of ``target`` left alone."""
    fresh = new.join(target.select(*keys), keys, "left_anti")
    return first_arrivals(fresh, keys, order)


def insert_outcome(new: DataFrame, target: DataFrame, keys: list[str], order: str = "arrival") -> DataFrame:
    """Per group of rows with one key: how many came, how many of them are new (0 or 1)."""
    known = target.select(*keys).withColumn("_known", F.lit(True))
    counted = new.groupBy(*keys).agg(F.count("*").alias("arrived"))
    joined = counted.join(known, keys, "left")
    return joined.select(*keys, "arrived", F.col("_known").isNull().cast("int").alias("inserted"))


def upsert(new: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with whole rows replaced or added; ``new`` has one row per key."""
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_group(
    new: DataFrame, target: DataFrame, group: list[str], groups: DataFrame | None = None
) -> DataFrame:
    """``target`` with all rows of the touched groups replaced by the rows of ``new``.

    Touched are the groups in ``groups`` (so one can also be emptied), else those in ``new``.
    """
    touched = (new if groups is None else groups).select(*group).distinct()
    return target.join(touched, group, "left_anti").unionByName(new)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """``target`` without the rows that meet the condition; unknown counts as not met."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def reset_attempts(postings: DataFrame) -> DataFrame:
    """Postings as before any scoring; their scores are deleted beside it."""
    return postings.withColumns({"score_attempts": F.lit(0), "score_error": F.lit(None).cast("string")})


KEY = ["profile", "id"]


def status_change_log(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """(profile, id, previous_status, new_status) where the posting exists and the status differs.

    ``changes`` is (profile, id, new_status, changed_at); the last change of a posting counts.
    """
    last = changes.groupBy(*KEY).agg(F.max_by("new_status", F.struct("changed_at", "new_status")).alias("new_status"))
    joined = postings.select(*KEY, F.coalesce("status", F.lit("new")).alias("previous_status")).join(last, KEY)
    return joined.where(F.col("previous_status") != F.col("new_status"))


def apply_status_changes(postings: DataFrame, log: DataFrame) -> DataFrame:
    moved = log.select(*KEY, "new_status")
    joined = postings.join(moved, KEY, "left")
    return joined.withColumn("status", F.coalesce("new_status", "status")).select(*postings.columns)


def undo_status_changes(postings: DataFrame, log: DataFrame) -> DataFrame:
    """Back to the previous status of every logged change."""
    moved = log.select(*KEY, "previous_status")
    joined = postings.join(moved, KEY, "left")
    return joined.withColumn("status", F.coalesce("previous_status", "status")).select(*postings.columns)


def record_attempts(postings: DataFrame, attempts: DataFrame) -> DataFrame:
    """Add tries and the last error of each posting. ``attempts`` is (profile, id, tried_at, error),
    one row per try; an error text replaces the earlier one, a try without error keeps it."""
    errors = F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("tried_at", "error")))
    tried = attempts.groupBy(*KEY).agg(F.count("*").alias("_tries"), errors.alias("_error"))
    joined = postings.join(tried, KEY, "left")
    return joined.withColumns(
        {
            "score_attempts": F.col("score_attempts") + F.coalesce("_tries", F.lit(0)).cast("int"),
            "score_error": F.coalesce(F.substring("_error", 1, vocab.MAX_ERROR_CHARS), "score_error"),
        }
    ).select(*postings.columns)


# ---- writing -------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with ``schema`` a missing one reads as empty and added columns as null."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path) if schema is None else (
            spark.read.schema(schema).parquet(path)
        )
        return found
    except AnalysisException as missing:
        if schema is None or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


@contextmanager
def staged(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows written to the shared folder and read back: cuts lineage, survives lost executors.

    The folder is removed when the write that needed it has succeeded; after a failure it stays.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    yield spark.read.schema(rows.schema).parquet(path)
    _remove(spark, path)


def append_new(new: DataFrame, path: str, schema: str, keys: list[str], partition_by: list[str], order: str = "arrival") -> None:
    """Insert-only load. A second run of the same batch adds nothing.

    Only the partitions that the batch touches are compared with it.
    """
    with staged(new) as batch:
        target = read_table(new.sparkSession, path, schema)
        append(insert_or_ignore(batch, _touched(target, batch, partition_by), keys, order), path, partition_by)


def rewrite_partitions(content: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions that occur in ``content``; it may be derived from ``path``."""
    with staged(content) as safe:
        safe.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def _touched(target: DataFrame, new: DataFrame, partition_by: list[str]) -> DataFrame:
    return target.join(new.select(*partition_by).distinct(), partition_by, "left_semi")


def upsert_table(new: DataFrame, path: str, schema: str, keys: list[str], partition_by: list[str]) -> None:
    """Whole-row upsert; reads and rewrites the touched partitions only.

    The new rows are used more than once, so they are stored first and computed once.
    """
    with staged(new) as fresh:
        target = read_table(new.sparkSession, path, schema)
        rewrite_partitions(upsert(fresh, _touched(target, fresh, partition_by), keys), path, partition_by)


def replace_groups_in_table(new: DataFrame, path: str, schema: str, group: list[str], partition_by: list[str]) -> None:
    """Group-wise replacement; the new rows (often from a model) are computed once."""
    with staged(new) as fresh:
        target = read_table(new.sparkSession, path, schema)
        rewrite_partitions(replace_group(fresh, _touched(target, fresh, partition_by), group), path, partition_by)


def _changed_partitions(path: str, schema: str, changes: DataFrame, partition_by: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrites the partitions that hold a posting of ``changes``."""
    table = read_table(changes.sparkSession, path, schema)
    hit = table.join(changes.select(*KEY).distinct(), KEY, "left_semi")
    rewrite_partitions(change(_touched(table, hit, partition_by)), path, partition_by)


def change_status_in_table(changes: DataFrame, path: str, schema: str, partition_by: list[str], log_path: str | None = None) -> None:
    """The last requested status of each posting, written; with ``log_path`` what changed is appended there first.

    The log makes the change undoable: its rows are those of ``status_change_log``.
    """
    log = status_change_log(read_table(changes.sparkSession, path, schema), changes)
    with staged(log) as done:
        if log_path is not None:
            done.write.mode("append").parquet(log_path)
        _changed_partitions(path, schema, done, partition_by, lambda rows: apply_status_changes(rows, done))


def record_attempts_in_table(attempts: DataFrame, path: str, schema: str, partition_by: list[str]) -> None:
    """Tries and last errors of postings, written. Not to be repeated after a success: tries are added up.

    ``sources.ledger`` has the form that may be repeated.
    """
    with staged(attempts) as tried:
        _changed_partitions(path, schema, tried, partition_by, lambda rows: record_attempts(rows, tried))


def delete_from_table(spark: SparkSession, path: str, schema: str, condition: Column, partition_by: list[str]) -> None:
    """Delete rows: only partitions with a matching row are rewritten, emptied ones removed."""
    table = read_table(spark, path, schema)
    hit = table.where(condition).select(*partition_by).distinct()
    with staged(delete_where(table.join(hit, partition_by, "left_semi"), condition)) as remaining:
        # Partition values only, so the list stays as short as the partition list of the table.
        emptied = hit.join(remaining.select(*partition_by).distinct(), partition_by, "left_anti").collect()
        if not remaining.isEmpty():
            remaining.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                *partition_by
            ).parquet(path)
    for row in emptied:
        drop_partition(spark, path, {c: row[c] for c in partition_by})


def drop_partition(spark: SparkSession, path: str, values: dict[str, object]) -> None:
    """Removes the folder of one partition, if it is there."""
    jvm = spark.sparkContext._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = "/".join(f"{c}={escape(str(v)) if v is not None else '__HIVE_DEFAULT_PARTITION__'}" for c, v in values.items())
    _remove(spark, f"{path.rstrip('/')}/{folder}")


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
