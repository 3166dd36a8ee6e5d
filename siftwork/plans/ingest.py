"""Landed payloads to qualified postings, with the funnel counts on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import predicates as P
from siftwork.operators.qualify import RULE_COLUMNS, reason_column, with_rules
from siftwork.sources.payloads import normalize_all
from siftwork.sources.profiles import enabled_only

POSTINGS = (
    "id string, title string, company string, location string, url string, raw_text string, score_attempts int, "
    "score_error string, status string, scrape_qualified boolean, scrape_filter_reason string, posted_at timestamp, "
    "created_at timestamp, profile string, source string"
)
POSTING_KEYS = ["profile", "source", "id"]
POSTING_PARTITIONS = ["profile", "source"]


def judge(normalized: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """Normalized postings with the flags of every stage: fresh, title_match, hard_no, reason.

    Later flags are computed only for postings that reach their stage.
    """
    ruled = with_rules(normalized, profiles)
    fresh = P.posted_within(F.col("posted_at"), F.col("max_age_days"), as_of)
    match = P.title_matches(F.col("title"), F.col("title_words"))
    reached = F.col("fresh") & F.col("title_match")
    flagged = (
        ruled.withColumn("fresh", fresh)
        .withColumn("title_match", match)
        .withColumn("hard_no", F.when(reached, P.contains_hard_no(F.col("full_text"), F.col("hard_no_pattern"))))
        .withColumn("scrape_filter_reason", F.when(reached & ~F.col("hard_no"), reason_column()))
    )
    return flagged.drop(*[c for c in RULE_COLUMNS if c != "profile"])


def admitted(judged: DataFrame) -> DataFrame:
    """Postings to store, created when they were fetched. Unqualified ones are stored with their reason, so they are not judged again."""
    kept = judged.where(F.col("fresh") & F.col("title_match") & ~F.col("hard_no"))
    return kept.select(
        "id", "title", "company", "location", "url", "raw_text",
        F.lit(0).alias("score_attempts"),
        F.lit(None).cast("string").alias("score_error"),
        F.lit("new").alias("status"),
        (F.col("scrape_filter_reason") == "").alias("scrape_qualified"),
        "scrape_filter_reason", "posted_at",
        F.col("fetched_at").alias("created_at"),
        "profile", "source",
    )


def admit_early(normalized: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """The same rows as ``admitted(judge(...))``, with age and title as plain filters that the
    optimizer pushes below the HTML and context extraction of the normalizers."""
    ruled = with_rules(normalized, profiles)
    reached = ruled.where(P.posted_within(F.col("posted_at"), F.col("max_age_days"), as_of)).where(
        P.title_matches(F.col("title"), F.col("title_words"))
    )
    clean = reached.where(~P.contains_hard_no(F.col("full_text"), F.col("hard_no_pattern")))
    flags = {"fresh": F.lit(True), "title_match": F.lit(True), "hard_no": F.lit(False)}
    return admitted(clean.withColumns({**flags, "scrape_filter_reason": reason_column()}))


def scrape_stats(judged: DataFrame, target: DataFrame) -> DataFrame:
    """Per profile and source, and in total (source null): scraped, filtered and saved.

    Boards count a posting as scraped once its title matches; the thread source counts every
    comment, and the feed counts a title mismatch as filtered only.
    """
    known = target.select("profile", "source", "id").distinct().withColumn("_known", F.lit(True))
    rows = judged.join(known, ["profile", "source", "id"], "left")
    thread, feed = F.col("source") == "hackernews", F.col("source") == "himalayas"
    fresh, match = F.col("fresh"), F.col("title_match")
    rejected = F.coalesce(F.col("hard_no"), F.lit(False)) | (F.coalesce("scrape_filter_reason", F.lit("")) != "")
    passed = F.coalesce(F.col("scrape_filter_reason") == "", F.lit(False))
    saved = passed & F.col("_known").isNull()
    return rows.rollup("profile", "source").agg(
        F.count_if(fresh & (match | thread)).alias("jobs_scraped"),
        F.count_if(fresh & F.when(match, rejected).otherwise(thread | feed)).alias("jobs_filtered"),
        F.count_distinct(F.when(saved, F.struct("profile", "source", "id"))).alias("jobs_saved"),
        F.grouping("source").alias("is_total"),
    ).where(F.col("profile").isNotNull())


def ingest(raw: DataFrame, profiles: DataFrame, as_of: Column, **options: int | bool | None) -> DataFrame:
    """Raw payload rows of all enabled sources to storable postings; see ``normalize_all`` for the options."""
    normalized = normalize_all(enabled_only(raw, profiles), as_of, **options)
    return admit_early(normalized, profiles, as_of)
