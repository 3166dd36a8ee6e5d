"""A versioned vector index: a (profile, model) group is re-embedded beside its old rows and readers switch at the end.

``<path>`` holds index rows, partitioned by profile, model and version; ``<path>-current`` says which version of a group counts.
A rebuild writes a whole new version, checks it, and only then appends the rows that make it current, in one file. Until
then every reader sees the old version, whatever happens to the rebuild; what a failed one left is written over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.chunking import Encoder, dimension_conflicts, embed_chunks
from siftwork.sources.tables import drop_partition, read_table, staged

GROUP = ["profile", "model_name"]
ROWS = (
    "uid string, job_id string, chunk_key string, chunk_order int, chunk_text string, embedding array<float>, dimensions int, "
    "profile string, model_name string, version long"
)
CURRENT = "profile string, model_name string, version long"
PARTITIONS = [*GROUP, "version"]


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def current_versions(spark: SparkSession, path: str) -> DataFrame:
    """(profile, model_name, version): the version of each group that counts, one row a group."""
    return read_table(spark, f"{path}-current", CURRENT).groupBy(*GROUP).agg(F.max("version").alias("version"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of the current versions; partitions of other versions are not read."""
    # One row per group of the index: a list as long as its partitions.
    return read_table(spark, path, ROWS).join(F.broadcast(current_versions(spark, path)), PARTITIONS, "left_semi")


def write_version(rows: DataFrame, path: str) -> None:
    """Makes ``rows`` (index rows without a version) the current version of their groups, as a whole.

    The rows of one group must have vectors of one length, else nothing is switched and an error tells which group it is.
    """
    spark = rows.sparkSession
    # Stored first: the rows may come from the index itself, whose files change below.
    with staged(rows) as fresh:
        held = F.broadcast(current_versions(spark, path).withColumnRenamed("version", "_held"))
        next_version = F.coalesce("_held", F.lit(0)) + 1
        versioned = fresh.join(held, GROUP, "left").withColumn("version", next_version).withColumn("dimensions", F.size("embedding"))
        versioned.select(*_columns(ROWS)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
        # What an earlier failure left of other groups is not looked at.
        groups = F.broadcast(fresh.select(*GROUP).distinct())
        written = read_table(spark, path, ROWS).join(groups, GROUP, "left_semi").join(held, GROUP, "left").where(F.col("version") == next_version)
        wrong = dimension_conflicts(written).limit(1).collect()
        if wrong:
            raise ValueError(f"vectors of {wrong[0]['least']} and {wrong[0]['most']} dimensions in one group: {wrong[0]['profile']}, {wrong[0]['model_name']}")
        written.select(*PARTITIONS).distinct().coalesce(1).write.mode("append").parquet(f"{path}-current")


def rebuild(
    spark: SparkSession, path: str, groups: DataFrame, make_encoder: Callable[[], Encoder], cache: str | None = None, model_name: str | None = None
) -> None:
    """Re-embeds the current rows of ``groups`` (profile, model_name) into a new version and switches to it.

    With ``model_name`` the new rows belong to that model, and the old model's rows stay current for those who ask for it.
    ``cache`` is a table of answers (see ``operators.calls``): a rebuild that is done again makes no call twice.
    """
    due = read_index(spark, path).join(F.broadcast(groups.select(*GROUP).distinct()), GROUP, "left_semi")
    names = [r["model_name"] for r in groups.select("model_name").distinct().collect()]  # one a model
    parts = [
        embed_chunks(due.where(F.col("model_name") == name).drop("embedding", "dimensions", "version"), model_name or name, make_encoder, cache or f"{path}-answers")
        for name in names
    ]
    for part in parts:
        write_version(part, path)


def rebuild_conflicts(spark: SparkSession, path: str, make_encoder: Callable[[], Encoder], cache: str | None = None) -> None:
    """Rebuilds every group whose vectors are not of one length."""
    wrong = dimension_conflicts(read_index(spark, path)).select(*GROUP)
    if not wrong.isEmpty():
        rebuild(spark, path, wrong, make_encoder, cache)


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Removes the partitions that no reader sees any more."""
    held = current_versions(spark, path).withColumnRenamed("version", "_held")
    old = read_table(spark, path, ROWS).select(*PARTITIONS).distinct().join(held, GROUP, "left").where(F.col("version") < F.col("_held"))
    for row in old.collect():  # partition values
        drop_partition(spark, path, {c: row[c] for c in PARTITIONS})
