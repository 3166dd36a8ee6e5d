"""The folds of the labelled documents, and a bounded sample of them to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
SAMPLE = 20_000  # labelled documents a model is fitted on, at most


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned: one fold of five, by the crc32 of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def all_fitting_labels(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label`` of all documents that may be learned from: labelled 0 or 1 and not held out.

    Of several labels of one document the largest counts; null ids and null labels are left out.
    """
    own = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max("label").alias("label"))


def fitting_labels(labels: DataFrame, column: str, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows of ``all_fitting_labels``, drawn by a hash of the id, so the same on every run."""
    return all_fitting_labels(labels, column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
