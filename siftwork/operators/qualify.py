"""Postings against the rules of their profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions import predicates as P
from siftwork.functions.strings import any_word_pattern, empty_strings, remembered, word_patterns

RULE_COLUMNS = [
    "profile", "title_words", "hard_no_pattern", "block_any", "block_terms", "block_patterns", "rule_min_yoe",
    "rule_max_yoe", "intent_keywords", "degree_filter", "max_age_days",
]


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), empty_strings())


def rules(profiles: DataFrame) -> DataFrame:
    """What qualification needs from a profile, patterns built once per profile row.

    No resume or bio travels along, so the rows stay small whatever the profiles hold.
    """
    return profiles.select("profile", *_rule_columns())


@remembered
def _rule_columns() -> list[Column]:
    return [
        P.title_words(_list("titles")).alias("title_words"),
        any_word_pattern(_list("hard_no_keywords")).alias("hard_no_pattern"),
        any_word_pattern(_list("title_blocklist")).alias("block_any"),
        _list("title_blocklist").alias("block_terms"),
        word_patterns(_list("title_blocklist")).alias("block_patterns"),
        F.coalesce("min_yoe", F.lit(vocab.DEFAULT_MIN_YOE)).alias("rule_min_yoe"),
        F.coalesce("max_yoe", F.lit(vocab.DEFAULT_MAX_YOE)).alias("rule_max_yoe"),
        F.concat(_list("titles"), _list("desired_skills")).alias("intent_keywords"),
        F.coalesce("require_degree_filter", F.lit(False)).alias("degree_filter"),
        F.coalesce("max_job_age_days", F.lit(vocab.DEFAULT_MAX_JOB_AGE_DAYS)).alias("max_age_days"),
    ]


def with_rules(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each posting beside the rules of its own profile.

    No hint: the planner broadcasts the rules while their measured size allows it, and
    otherwise sorts and splits skewed profiles.
    """
    return postings.join(rules(profiles), "profile", "inner")


@remembered
def reason_column(text: str = "full_text", location: str = "filter_location") -> Column:
    return P.filter_reason(
        F.col("source"), F.col("title"), F.col(text), F.col(location),
        block_any=F.col("block_any"), block_terms=F.col("block_terms"), block_patterns=F.col("block_patterns"),
        min_yoe=F.col("rule_min_yoe"), max_yoe=F.col("rule_max_yoe"),
        intent_keywords=F.col("intent_keywords"), degree_filter=F.col("degree_filter"),
    )


def qualify(
    postings: DataFrame, profiles: DataFrame, text: str = "full_text", location: str = "filter_location"
) -> DataFrame:
    """Add ``scrape_qualified`` and ``scrape_filter_reason``; nothing is dropped."""
    extra = [c for c in RULE_COLUMNS if c != "profile"]
    judged = with_rules(postings, profiles).withColumn("scrape_filter_reason", reason_column(text, location))
    return judged.drop(*extra).withColumn("scrape_qualified", F.col("scrape_filter_reason") == "")


def title_filter(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Postings whose title matches a preferred title."""
    joined = postings.join(rules(profiles).select("profile", "title_words"), "profile")
    return joined.where(P.title_matches(F.col("title"), F.col("title_words"))).drop("title_words")


def hard_no_filter(postings: DataFrame, profiles: DataFrame, text: str = "full_text") -> DataFrame:
    """Postings without any excluded keyword."""
    joined = postings.join(rules(profiles).select("profile", "hard_no_pattern"), "profile")
    return joined.where(~P.contains_hard_no(F.col(text), F.col("hard_no_pattern"))).drop("hard_no_pattern")


def fresh_filter(postings: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """Postings young enough at ``as_of``; undated ones stay."""
    joined = postings.join(rules(profiles).select("profile", "max_age_days"), "profile")
    return joined.where(P.posted_within(F.col("posted_at"), F.col("max_age_days"), as_of)).drop("max_age_days")
