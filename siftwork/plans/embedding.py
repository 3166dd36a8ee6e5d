"""Incremental embedding of scored postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.chunking import DEFAULT_MODEL, Encoder, chunk_and_embed
from siftwork.operators.review import pending_embeddings
from siftwork.sources.tables import append, read_table, replace_groups_in_table

CHUNKS = (
    "job_id string, chunk_key string, chunk_order int, chunk_text string, embedding array<float>, dimensions int, "
    "created_at timestamp, profile string, model_name string"
)
CHUNK_GROUP = ["profile", "job_id", "model_name"]
CHUNK_PARTITIONS = ["profile", "model_name"]


def embed_pending(
    postings: DataFrame, scores: DataFrame, path: str, created_at, model_name: str = DEFAULT_MODEL,
    make_encoder: Callable[[], Encoder] | None = None, force: bool = False,
) -> None:
    """Chunk and encode what has no vectors of this model yet, and store it; a second run adds nothing."""
    spark = postings.sparkSession
    stored = read_table(spark, path, CHUNKS)
    due = pending_embeddings(postings, scores, stored, model_name, force)
    fresh = chunk_and_embed(due, model_name, make_encoder).withColumn("created_at", created_at)
    columns = [f.split()[0] for f in CHUNKS.split(", ")]
    if force:
        replace_groups_in_table(fresh.select(*columns), path, CHUNKS, CHUNK_GROUP, CHUNK_PARTITIONS)
    else:
        # What is due has no chunk yet, so nothing stored has to be rewritten.
        append(fresh.select(*columns), path, CHUNK_PARTITIONS)


def embedding_stats(chunks: DataFrame) -> DataFrame:
    """Per profile and model: postings and chunks."""
    return chunks.groupBy("profile", "model_name").agg(
        F.count_distinct("job_id").alias("jobs"), F.count("*").alias("chunks")
    )
