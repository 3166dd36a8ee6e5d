"""Calls of a model, once per distinct input: answers are kept in a table addressed by content.

The address of a call is a digest of the model's name and of its inputs. ``answered`` finds the distinct
addresses of its rows that the table doesn't hold, runs the model on those alone, appends the answers and then joins
them to all rows. A run that is repeated, after a failure or on the same rows, calls the model for nothing it
has stored. The table is partitioned by model and by the first hex digit of the address.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.strings import text_of
from siftwork.sources.tables import append, read_table

# Inputs of one call, a list per input column; an answer for each row.
Call = Callable[..., "list[Any]"]

PARTITIONS = ["model", "shelf"]


def address(model: str, inputs: list[Column]) -> Column:
    """Digest of a model's name and its inputs; their lengths keep different inputs apart, null counts as empty."""
    parts = [F.concat(F.length(text_of(c)).cast("string"), F.lit(":"), text_of(c)) for c in (F.lit(model), *[i.cast("string") for i in inputs])]
    return F.sha2(F.concat(*parts), 256)


def _schema(kind: str) -> str:
    return f"address string, answer {kind}, model string, shelf string"


def stored_answers(spark: SparkSession, path: str, model: str, kind: str) -> DataFrame:
    """(address, answer) of one model. Two runs at a time may have stored the same call twice; one answer is taken."""
    rows = read_table(spark, path, _schema(kind)).where(F.col("model") == model)
    return rows.select("shelf", "address", "answer").dropDuplicates(["shelf", "address"])


def _calling(make_call: Callable[[], Call], inputs: list[str], kind: pa.DataType, batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                rows = batch.slice(start, batch_size)
                # A task without rows loads no model.
                call = call or make_call()
                answers = call(*[rows.column(f"_in_{c}").to_pylist() for c in inputs])
                if len(answers) != rows.num_rows:
                    raise ValueError(f"{rows.num_rows} inputs, {len(answers)} answers")
                yield pa.RecordBatch.from_arrays([rows.column("address"), pa.array(answers, kind)], names=["address", "answer"])

    return run


def missing_calls(rows: DataFrame, path: str, model: str, inputs: list[str], kind: str) -> DataFrame:
    """(shelf, address, inputs) of the distinct calls that the table at ``path`` has no answer for."""
    columns = [text_of(F.col(c).cast("string")).alias(f"_in_{c}") for c in inputs]
    keyed = rows.select(address(model, [F.col(c) for c in inputs]).alias("address"), *columns)
    # Equal calls are combined before they move.
    calls = keyed.groupBy("address").agg(*[F.first(f"_in_{c}").alias(f"_in_{c}") for c in inputs])
    calls = calls.withColumn("shelf", F.substring("address", 1, 1))
    return calls.join(stored_answers(rows.sparkSession, path, model, kind).drop("answer"), ["shelf", "address"], "left_anti")


def answered(
    rows: DataFrame, path: str, model: str, inputs: list[str], make_call: Callable[[], Call], kind: str, batch_size: int, answer: str = "answer"
) -> DataFrame:
    """``rows`` with the model's answer for the columns ``inputs`` in the column ``answer``.

    ``make_call`` runs once per task and returns ``call(*lists) -> answers``; it gets ``batch_size`` rows at a time, however
    large Spark's own batches are. Nulls reach it as empty texts. ``kind`` is the type of an answer. What is missing is
    computed and stored at once; what comes back only reads the table.
    """
    spark = rows.sparkSession
    arrow = spark.createDataFrame([], f"answer {kind}").toArrow().schema.field("answer").type
    missing = missing_calls(rows, path, model, inputs, kind)
    # Calls are dealt out evenly, whatever the shelf they are kept on.
    fresh = missing.repartition("address").mapInArrow(_calling(make_call, inputs, arrow, batch_size), f"address string, answer {kind}")
    append(fresh.select("address", "answer", F.lit(model).alias("model"), F.substring("address", 1, 1).alias("shelf")), path, PARTITIONS)
    keyed = rows.withColumn("_address", address(model, [F.col(c) for c in inputs])).withColumn("_shelf", F.substring("_address", 1, 1))
    found = stored_answers(spark, path, model, kind).select(F.col("shelf").alias("_shelf"), F.col("address").alias("_address"), F.col("answer").alias(answer))
    return keyed.join(found, ["_shelf", "_address"], "left").drop("_shelf", "_address")
