"""Second pass over retrieved chunks: selection, weighted scores, evidence, final order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork import vocab
from siftwork.functions import text as X
from siftwork.functions.strings import (
    contains_any, contains_any_of, dedupe_ignoring_case, empty_strings, first_of, let, lookup, round4, string_array, strip,
    term_table,
)
from siftwork.functions.vectors import clamp_k
from siftwork.operators.calls import answered
from siftwork.operators.retrieval import mean_of_first

PAIR = ["query_id", "job_id"]


def wants_compensation(query: Column) -> Column:
    return contains_any(F.lower(query), vocab.COMPENSATION_TERMS)


def wants_benefits(query: Column) -> Column:
    return contains_any(F.lower(query), vocab.BENEFITS_TERMS)


# ---- selection -----------------------------------------------------------------------------


def best_per_section(hits: Column) -> Column:
    """The most similar hit of each section, from an array that has the most similar first."""
    return F.filter(
        hits, lambda h, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda x: x["chunk_key"] == h["chunk_key"])
    )


def pick_chunks(hits: Column, match_query: Column, n: int | None = None) -> Column:
    """At most ``n`` hits of a posting, one per section, in picking order.

    Requirements, responsibilities and summary come first, then compensation and benefits
    if the query asks for them, then the rest by priority. Weakly similar benefits are left
    out unless asked for.
    """
    n = clamp_k(n, vocab.RERANK_CHUNKS_PER_JOB, vocab.RERANK_CHUNKS_PER_JOB_MAX)
    return let(
        F.struct(wants_compensation(match_query).alias("pay"), wants_benefits(match_query).alias("perks")),
        lambda wish: _picked(hits, wish["pay"], wish["perks"], n),
    )


def _picked(hits: Column, pay: Column, perks: Column, n: int) -> Column:
    def with_order(h: Column) -> Column:
        key = h["chunk_key"]
        asked = ((key == "compensation") & pay) | ((key == "benefits") & perks)
        turn = F.coalesce(
            lookup({"requirements": 1, "responsibilities": 2, "summary": 3}, key),
            F.when(asked, lookup({"compensation": 4, "benefits": 5}, key)),
            F.lit(10),
        )
        priority = F.when(asked, 3).otherwise(F.coalesce(lookup(vocab.SECTION_PRIORITY, key), F.lit(0)))
        return F.struct(
            turn.alias("turn"), (-priority).alias("priority"), (-h["similarity"]).alias("dissimilarity"),
            h["chunk_order"].alias("chunk_order"), key.alias("chunk_key"), h["similarity"].alias("similarity"),
            h["uid"].alias("uid"), h["chunk_text"].alias("chunk_text"),
        )

    allowed = F.filter(
        let(hits, best_per_section),
        lambda h: (h["chunk_key"] != "benefits") | perks | (h["similarity"] >= 0.55),
    )
    return F.slice(F.array_sort(F.transform(allowed, with_order)), 1, n)


def select_chunks(jobs: DataFrame, queries: DataFrame, n: int | None = None) -> DataFrame:
    """Retrieved postings with one row per selected chunk.

    ``jobs`` comes from ``roll_up``, ``queries`` has query_id, match_query and the intent
    columns. A posting without any allowed chunk keeps one row without a chunk.
    """
    intents = queries.drop("profile", "query_vec", "query_text")
    picked = jobs.join(intents, "query_id").withColumn("_p", pick_chunks(F.col("hits"), F.col("match_query"), n))
    rows = picked.drop("hits").select(
        *[c for c in picked.columns if c not in ("hits", "_p")], F.posexplode_outer("_p").alias("pick_order", "_c")
    )
    chunk = [F.col(f"_c.{c}").alias(c) for c in ("chunk_key", "chunk_order", "similarity", "uid", "chunk_text")]
    return rows.select(*[c for c in rows.columns if c != "_c"], *chunk)


# ---- chunk scores --------------------------------------------------------------------------


def section_weight(section: Column, match_query: Column, family: Column) -> Column:
    """Section weight in reranking: pay and perks of the query first, then the family table."""
    pay, perks = wants_compensation(match_query), wants_benefits(match_query)
    asked = F.when(section == "compensation", F.when(pay, F.lit(1.05))).when(
        section == "benefits", F.when(pay | perks, F.lit(1.00))
    )

    def of_family(name: Column) -> Column:
        return lookup(_FAMILY_WEIGHTS, F.concat(name, F.lit("/"), section))

    return F.coalesce(asked, of_family(family), of_family(F.lit("general")), F.lit(1.0))


_FAMILY_WEIGHTS = {
    f"{family}/{section}": weight
    for family, weights in vocab.FAMILY_SECTION_WEIGHTS.items()
    for section, weight in weights.items()
}


def lexical_score(query: Column, text: Column) -> Column:
    """A raw score without a model: share of distinct query terms in the text, on -4..4."""

    def share(terms: Column, low: Column) -> Column:
        found = F.size(F.filter(terms, lambda t: F.contains(low, t))).cast("double")
        return F.when(F.size(terms) > 0, found / F.size(terms)).otherwise(F.lit(0.0))

    terms = F.array_distinct(F.transform(X.query_terms(query), F.lower))
    return let(terms, lambda ts: let(F.lower(text), lambda low: share(ts, low))) * 8.0 - 4.0


def model_scorer(make_model: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer from a pair model: ``make_model()`` runs once per task, batches are Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make_model()
        for queries, texts in batches:
            yield pd.Series(predict(queries.tolist(), texts.tolist()), dtype="float64")

    return score


def cached_raw_scores(
    selected: DataFrame, make_model: Callable[[], Callable[[list[str], list[str]], list[float]]], model_name: str, cache: str,
    max_chars: int = vocab.RERANK_CHUNK_CHARS, batch_size: int = vocab.RERANKER_BATCH,
) -> DataFrame:
    """``selected`` with a ``raw_score`` for ``rerank_chunks``, from a pair model that sees each distinct pair once.

    Scores are kept in the table ``cache``; a pair is the match query and the prepared chunk text.
    """
    max_chars = max(vocab.RERANK_CHUNK_CHARS_MIN, min(vocab.RERANK_CHUNK_CHARS_MAX, max_chars))
    prepared = selected.withColumn("_text", X.prepare_chunk_text(F.col("chunk_text"), max_chars))
    return answered(prepared, cache, model_name, ["match_query", "_text"], make_model, "double", batch_size, "raw_score").drop("_text")


def rerank_chunks(
    selected: DataFrame, scorer: Callable[[Column, Column], Column] | None = None,
    max_chars: int = vocab.RERANK_CHUNK_CHARS,
) -> DataFrame:
    """Add the normalized and section-weighted score of each selected chunk.

    Needs ``match_query`` and ``role_family``; uses a ``raw_score`` column when there is one.
    """
    if "raw_score" not in selected.columns:
        max_chars = max(vocab.RERANK_CHUNK_CHARS_MIN, min(vocab.RERANK_CHUNK_CHARS_MAX, max_chars))
        prepared = X.prepare_chunk_text(F.col("chunk_text"), max_chars)
        if scorer is None:
            selected = selected.withColumn("raw_score", lexical_score(F.col("match_query"), prepared))
        else:
            # The one-element explode keeps the text work in its own step, below a Python scorer.
            texts = selected.withColumn("_text", F.explode(F.array(prepared)))
            selected = texts.withColumn("raw_score", scorer(F.col("match_query"), F.col("_text"))).drop("_text")
    logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("raw_score")))
    weight = section_weight(F.col("chunk_key"), F.col("match_query"), F.col("role_family"))
    return selected.withColumns(
        {
            "vector_similarity": round4(F.col("similarity")),
            "cross_score": round4(F.col("raw_score")),
            "normalized_score": round4(logistic),
            "weighted_score": round4(F.least(F.lit(1.0), logistic * weight)),
        }
    )


# ---- evidence ------------------------------------------------------------------------------


def evidence_terms(match_query: Column, texts: Column) -> Column:
    """Up to five distinct query terms found in the first three chunk texts."""
    present = let(
        F.lower(F.array_join(F.slice(texts, 1, 3), " ")),
        lambda low: F.filter(X.query_terms(match_query), lambda t: F.contains(low, F.lower(t))),
    )
    return F.slice(dedupe_ignoring_case(present), 1, 5)


def _prefixed(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def match_evidence(title: Column, texts: Column, terms: Column) -> Column:
    """Deterministic signals for and against a posting, from the columns of an intent row."""
    return let(
        F.lower(F.array_join(texts, " ")),
        lambda combined: let(F.lower(title), lambda job_title: _signals(job_title, combined, terms)),
    )


def _signals(job_title: Column, combined: Column, terms: Column) -> Column:
    def said(term: Column) -> Column:
        return F.contains(combined, F.lower(term))

    roles = F.filter(
        F.slice("target_roles", 1, 3),
        lambda r: F.exists(
            F.filter(F.split(F.lower(r), r"\s+"), lambda w: F.length(w) > 2), lambda w: F.contains(job_title, w)
        ),
    )
    skills = F.slice(dedupe_ignoring_case(F.concat("domain_skills", "tools")), 1, 12)
    found = F.slice(F.filter(skills, said), 1, 5)
    remote = F.col("remote_ok") & F.contains(combined, F.lit("remote"))
    place = first_of(F.filter(F.slice("locations", 1, 2), said))
    industry = first_of(F.filter(F.slice("industries", 1, 2), said))

    # A null part leaves the whole text null, so an absent signal is an absent entry.
    def positive(keywords: Column) -> Column:
        return F.array(
            _prefixed("Title match: ", first_of(roles)),
            F.when(F.size(keywords) > 0, _prefixed("Skills present: ", F.array_join(keywords, ", "))),
            F.when(remote, F.lit("Remote-friendly posting")).otherwise(_prefixed("Location match: ", place)),
            _prefixed("Industry match: ", industry),
        )

    senior = first_of(F.filter(string_array(vocab.SENIOR_TITLE_SIGNALS), lambda s: F.contains(job_title, s)))
    junior = F.col("seniority").isin("entry", "mid", "intern")
    asked = F.filter(
        term_table(vocab.CREDENTIAL_PHRASES),
        lambda row: contains_any_of(combined, row["terms"])
        & ~F.exists("credentials", lambda c: F.contains(F.lower(c), F.lower(row["key"]))),
    )["key"]
    elsewhere = (
        ~F.col("remote_ok") & (F.size("locations") > 0) & contains_any(combined, vocab.ONSITE_PHRASES)
        & ~F.exists("locations", said)
    )
    unpaid = (
        (F.col("job_type") == "internship")
        & (F.col("compensation.intern_pay_preference") == "paid_only")
        & F.contains(combined, F.lit("unpaid"))
    )
    first_concerns = F.array(
        F.when(
            junior & senior.isNotNull(),
            F.concat(F.lit("Seniority concern: posting appears "), strip(senior), F.lit("-level")),
        ),
        F.when(contains_any(combined, vocab.CLEARANCE_PHRASES), F.lit("Clearance requirement detected")),
        F.when(contains_any(combined, vocab.NO_SPONSOR_PHRASES), F.lit("Work authorization requirement detected")),
    )
    last_concerns = F.array(
        F.when(unpaid, F.lit("Posting may be unpaid (profile requires paid internship)")),
        F.when(elsewhere, F.lit("Location may not match profile preferences")),
    )

    def evidence(missing: Column, keywords: Column) -> Column:
        required = F.transform(missing, lambda label: _prefixed("Credential may be required: ", label))
        return F.struct(
            F.slice(F.array_compact(positive(keywords)), 1, 5).alias("positive"),
            F.slice(F.array_compact(F.concat(first_concerns, required, last_concerns)), 1, 5).alias("concerns"),
            F.slice(dedupe_ignoring_case(F.concat(F.slice(terms, 1, 8), keywords)), 1, 8).alias("matched_keywords"),
            F.slice(missing, 1, 4).alias("missing_or_unclear"),
        )

    return let(asked, lambda missing: let(found, lambda keywords: evidence(missing, keywords)))


def match_reason(section_scores: Column, terms: Column) -> Column:
    def at(section: str) -> Column:
        return F.coalesce(F.try_element_at(section_scores, F.lit(section)), F.lit(0.0))

    strong = F.array_compact(
        F.array(*[F.when(at(s) >= 0.55, F.lit(s)) for s in ("requirements", "responsibilities", "summary")])
    )
    label = F.array_join(F.slice(strong, 1, 2), " and ")
    listed = F.array_join(F.slice(terms, 1, 4), ", ")
    return (
        F.when(F.size(strong) == 0, F.lit("Moderate semantic match from supporting job sections."))
        .when(listed != "", F.concat(F.lit("Strong "), label, F.lit(" match for "), listed, F.lit(".")))
        .otherwise(F.concat(F.lit("Strong match in "), label, F.lit(".")))
    )


# ---- postings ------------------------------------------------------------------------------

_NO_EVIDENCE = ("positive", "concerns", "matched_keywords", "missing_or_unclear")


def _fallback_fields() -> dict[str, Column]:
    """What a reranked result shows for a posting that has only its vector result."""
    # A section may occur more than once; its last score wins, as in a dictionary.
    pairs = F.transform("chunk_scores", lambda c: F.struct(c["chunk_key"].alias("k"), c["weighted_similarity"].alias("v")))
    last = F.aggregate(
        pairs, F.array().cast("array<struct<k:string,v:double>>"),
        lambda acc, p: F.array_append(F.filter(acc, lambda a: a["k"] != p["k"]), p),
    )
    return {
        "matched_sections": F.col("matched_chunks"),
        "section_scores": F.map_from_entries(last),
        "best_chunk_key": F.coalesce(first_of(F.col("matched_chunks")), F.lit("")),
        "match_reason": F.col("retrieval_reason"),
        "evidence_snippets": empty_strings(),
        "evidence": F.struct(*[empty_strings().alias(n) for n in _NO_EVIDENCE]),
    }


_POSTING = ["profile", "query_id", "job_id", "title", "company", "source", "url"]
_SCORES = ["vector_score", "rerank_score", "final_score"]


def vector_fallback(jobs: DataFrame) -> DataFrame:
    """Retrieved postings in the shape of reranked ones."""
    score = round4(F.col("aggregate_score"))
    fields = [c.alias(n) for n, c in _fallback_fields().items()]
    return jobs.select(*_POSTING, *[score.alias(n) for n in _SCORES], *fields)


_PER_JOB = [
    "profile", "title", "company", "source", "url", "aggregate_score", "matched_chunks", "chunk_scores",
    "retrieval_reason", "match_query", "target_roles", "domain_skills", "tools", "remote_ok", "locations", "industries",
    "seniority", "credentials", "compensation", "job_type",
]


def rerank_jobs(scored_chunks: DataFrame, k: int | None = None) -> DataFrame:
    """Postings re-scored from their selected chunks, with evidence.

    ``scored_chunks`` comes from ``rerank_chunks``. Postings without a selected chunk drop
    out; a query without any selected chunk keeps its vector result. With ``k`` only the
    best k per query stay, and evidence is collected for those alone.
    """
    chunk = F.struct(
        (-F.col("weighted_score")).alias("o1"), (-F.col("normalized_score")).alias("o2"),
        (-F.col("vector_similarity")).alias("o3"), F.col("pick_order").alias("o4"),
        "chunk_key", "weighted_score", "chunk_text",
    )
    # Forty postings a query at most, eight chunks a posting.
    per_job = scored_chunks.groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.when(F.col("chunk_key").isNotNull(), chunk))).alias("chunks"),
        F.any_value(F.struct(*_PER_JOB)).alias("_job"),
    )
    joined = per_job.select(*PAIR, "_job.*", "chunks").withColumn(
        "_none_selected", F.max(F.size("chunks")).over(Window.partitionBy("query_id")) == 0
    )
    base = joined.where((F.size("chunks") > 0) | F.col("_none_selected")).withColumns(
        {
            "_sections": F.map_from_entries(F.transform("chunks", lambda c: F.struct(c["chunk_key"], c["weighted_score"]))),
            "_weighted": F.transform("chunks", lambda c: c["weighted_score"]),
        }
    )

    def at(section: str) -> Column:
        return F.coalesce(F.try_element_at("_sections", F.lit(section)), F.lit(0.0))

    pair_bonus = F.when((at("requirements") >= 0.55) & (at("responsibilities") >= 0.55), 0.07).otherwise(0.0)
    bonus = F.least(F.lit(0.10), pair_bonus + F.when(at("summary") >= 0.50, 0.03).otherwise(0.0))
    rerank = F.least(
        F.lit(1.0), first_of(F.col("_weighted")) * 0.55 + mean_of_first(F.col("_weighted")) * 0.30 + bonus
    )
    none = F.col("_none_selected")
    graded = base.withColumn("_rerank", F.when(none, F.col("aggregate_score")).otherwise(rerank))
    final = F.least(F.lit(1.0), F.col("_rerank") + F.col("aggregate_score") * 0.05)
    scored = graded.withColumns(
        {
            "vector_score": round4(F.col("aggregate_score")),
            "rerank_score": round4(F.col("_rerank")),
            "final_score": round4(F.when(none, F.col("aggregate_score")).otherwise(final)),
        }
    )
    rank = []
    if k is not None:
        scored, rank = final_top_k(scored, k), ["final_rank"]

    texts = F.transform("chunks", lambda c: c["chunk_text"])
    explained = scored.withColumn("_texts", texts).withColumn(
        "_terms", evidence_terms(F.col("match_query"), F.col("_texts"))
    )
    found = {
        "matched_sections": F.slice(F.transform("chunks", lambda c: c["chunk_key"]), 1, 4),
        "section_scores": F.col("_sections"),
        "best_chunk_key": first_of(F.col("chunks"))["chunk_key"],
        "match_reason": match_reason(F.col("_sections"), F.col("_terms")),
        "evidence_snippets": F.transform(F.slice("_texts", 1, 2), lambda t: X.snippet(t, F.col("_terms"))),
        "evidence": match_evidence(F.col("title"), F.col("_texts"), F.col("_terms")),
    }
    fallback = _fallback_fields()
    fields = [F.when(none, fallback[n]).otherwise(c).alias(n) for n, c in found.items()]
    return explained.select(*_POSTING, *_SCORES, *fields, *rank)


def final_top_k(results: DataFrame, k: int | None = None) -> DataFrame:
    k = clamp_k(k, vocab.RERANK_FINAL, vocab.TOP_JOBS_MAX)
    w = Window.partitionBy("query_id").orderBy(
        F.desc("final_score"), F.desc("rerank_score"), F.desc("vector_score"), "job_id"
    )
    return results.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)


def select_for_scoring(results: DataFrame, threshold: float, k: int) -> DataFrame:
    """The best postings per query at or above a threshold, for the expensive scorer."""
    good = results.where(F.col("final_score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "job_id")
    return good.withColumn("score_rank", F.row_number().over(w)).where(F.col("score_rank") <= max(0, k))
