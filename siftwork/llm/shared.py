"""Tables in the shared folder of the cluster: how long plans are cut and how files are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwork.session import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own below the folder that ``spark.checkpoint.dir`` names."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: no task before them runs twice."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
