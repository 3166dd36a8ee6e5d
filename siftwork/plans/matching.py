"""Which postings fit these profiles? Retrieval, reranking and evidence in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.operators import rerank as R
from siftwork.operators import retrieval as V
from siftwork.operators.chunking import hashing_encoder
from siftwork.operators.intents import match_query, normalize_profiles, vector_query


def match_requests(
    profiles: DataFrame, requests: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None,
    profile_context: bool = True, query_context: bool = True,
) -> DataFrame:
    """Requests (query_id, profile, user_text) with intent, texts and query vector.

    A request that already has a ``query_vec`` keeps it.
    """
    intents = normalize_profiles(profiles)
    asked = requests.join(intents, "profile")
    texts = asked.withColumn("query_text", vector_query(F.col("user_text"))).withColumn(
        "match_query", match_query(F.col("user_text"), profile_context, query_context)
    )
    if "query_vec" in texts.columns:
        return texts
    if encode is not None:
        return encode(texts)
    return hashing_encoder(texts, "query_text", "query_vec")


def semantic_match(
    chunks: DataFrame, queries: DataFrame, *,
    k_chunks: int = vocab.RERANK_TOP_CHUNKS, k_jobs: int = vocab.RERANK_TOP_JOBS, k_final: int = vocab.RERANK_FINAL,
    chunks_per_job: int | None = None, scorer: Callable[[Column, Column], Column] | None = None,
    reranking: bool = True, metric: str = "cosine",
) -> DataFrame:
    """Final matches per query. ``queries`` comes from ``match_requests``.

    The search runs once: its hits travel with the postings they belong to, so the second
    pass reads no chunk again. Every later step works on at most ``k_chunks`` rows a query.
    """
    hits = V.similar_chunks(chunks, queries, k_chunks, metric=metric)
    jobs = V.top_jobs_per_query(V.roll_up(hits), k_jobs)
    if not reranking:
        return R.final_top_k(R.vector_fallback(jobs), k_final)
    selected = R.select_chunks(jobs, queries, chunks_per_job)
    return R.rerank_jobs(R.rerank_chunks(selected, scorer), k_final)
