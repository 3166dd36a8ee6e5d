"""How the rows of the fingerprints are dealt out."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.llm import sketches


def test_every_block_has_a_task_of_its_own(spark):
    rows = [(i, f"text number {i} with some words") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "x"), (7, None)], "doc_id long, text string")
    found = sketches.neighbours(docs).groupBy(F.spark_partition_id().alias("task")).agg(F.collect_set("block").alias("blocks"), F.count("*").alias("n")).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(len(r["blocks"]) == 1 for r in found) and len(found) == parts
    assert max(r["n"] for r in found) <= 2 * (len(rows) / parts + 2)
