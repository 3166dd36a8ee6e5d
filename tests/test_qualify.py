import pytest
from pyspark.sql import functions as F

from siftwork.functions import predicates as P
from siftwork.operators import qualify as Q

POSTING = "profile string, id string, source string, title string, full_text string, filter_location string"

# name, source, title, text, location, expected reason
CASES = [
    ("plain", "greenhouse", "Software Engineer", "python", "Austin, TX", ""),
    ("blocked", "lever", "Staff Engineer", "x", "Remote", "title_blocklist: staff"),
    ("blocked_case", "ashby", "SENIOR developer", "x", "Remote", "title_blocklist: senior"),
    ("blocked_two_words", "workable", "Sales Development Rep", "x", "Remote", "title_blocklist: sales development"),
    ("word_boundary", "greenhouse", "Staffing Engineer", "x", "Remote", ""),
    ("accented_neighbour", "greenhouse", "Ingénieur éstaff", "x", "Remote", ""),
    ("list_order", "greenhouse", "Senior Staff", "x", "Remote", "title_blocklist: staff"),
    ("body_not_scanned", "greenhouse", "Engineer", "work with senior staff", "Remote", ""),
    ("body_scanned_in_thread", "hackernews", "Engineer", "hiring python, remote, senior only", "", "title_blocklist: senior"),
    ("yoe_high", "greenhouse", "Engineer", "8+ years needed", "Remote", "yoe_max: 8 > 5"),
    ("yoe_edge", "greenhouse", "Engineer", "5+ years needed", "Remote", ""),
    ("yoe_range", "greenhouse", "Engineer", "4-7 years", "Remote", "yoe_max: 7 > 5"),
    ("yoe_none", "greenhouse", "Engineer", "many years", "Remote", ""),
    ("us_state", "greenhouse", "Engineer", "", "Boise, ID", ""),
    ("us_state_lower", "greenhouse", "Engineer", "", "boise, id", "non_us_location"),
    ("us_word", "greenhouse", "Engineer", "", "US", ""),
    ("bare_usa", "greenhouse", "Engineer", "", "USA", "non_us_location"),
    ("in_usa", "greenhouse", "Engineer", "", "Somewhere, USA", ""),
    ("brussels", "greenhouse", "Engineer", "", "Brussels", "non_us_location"),
    ("placeholder", "greenhouse", "Engineer", "", " N/A ", ""),
    ("empty_place", "greenhouse", "Engineer", "", "", ""),
    ("remote_abroad", "greenhouse", "Engineer", "", "Remote, Denmark", "non_us_location"),
    ("milwaukee", "greenhouse", "Engineer", "", "Milwaukee, WI", "non_us_location"),
    ("indiana", "greenhouse", "Engineer", "", "Indiana", "non_us_location"),
    ("state_name", "greenhouse", "Engineer", "", "Rural Vermont", ""),
    ("city", "greenhouse", "Engineer", "", "NYC office", ""),
    ("city_inside_word", "greenhouse", "Engineer", "", "Lausanne", "non_us_location"),
    ("mixed", "greenhouse", "Engineer", "", "San Francisco, CA | Berlin", "non_us_location"),
    ("himalayas", "himalayas", "Engineer", "", "London", "non_us_location"),
    ("thread_ok", "hackernews", "Engineer", "We are hiring a software engineer, remote", "", ""),
    ("thread_no_intent", "hackernews", "Engineer", "software engineer, remote", "", "hiring_intent_not_found"),
    ("thread_far", "hackernews", "Engineer", "hiring " + "w " * 60 + "python remote", "", "hiring_intent_not_found"),
    ("thread_near", "hackernews", "Engineer", "hiring " + "w " * 45 + "python remote", "", ""),
    ("thread_abroad", "hackernews", "Engineer", "hiring python in Toronto, remote", "", "non_us_location"),
    ("thread_us_and_abroad", "hackernews", "Engineer", "hiring python in Toronto and Austin", "", ""),
    ("thread_nowhere", "hackernews", "Engineer", "hiring python people", "", "non_us_location"),
    ("unknown_source", "careers", "Engineer", "text", "Paris", ""),
    ("unknown_source_body", "careers", "Engineer", "a senior one", "Paris", "title_blocklist: senior"),
]


def test_reasons(spark, profile_rows):
    rows = [("p", name, source, title, text, place) for name, source, title, text, place, _ in CASES]
    judged = Q.qualify(spark.createDataFrame(rows, POSTING), profile_rows())
    got = {r["id"]: (r["scrape_filter_reason"], r["scrape_qualified"]) for r in judged.collect()}
    assert got == {name: (reason, reason == "") for name, *_, reason in CASES}


def test_empty_lists_and_defaults(spark, profile_rows):
    profiles = profile_rows(dict(title_blocklist=[], hard_no_keywords=[], min_yoe=None, max_yoe=None))
    rows = [("p", "a", "greenhouse", "Senior", "40+ years", "Remote")]
    assert Q.qualify(spark.createDataFrame(rows, POSTING), profiles).first()["scrape_filter_reason"] == ""


@pytest.mark.parametrize(
    "text,required",
    [
        ("A master's degree is required", True),
        ("PhD required", True),
        ("must have an MS", True),
        ("for students pursuing a master's degree", False),
        ("BS preferred", False),
    ],
)
def test_degree(spark, text, required):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(P.requires_advanced_degree(F.col("t"))).first()[0] is required


def test_degree_only_when_enabled(spark, profile_rows):
    rows = [("p", "a", "greenhouse", "Engineer", "PhD required", "Remote")]
    on = Q.qualify(spark.createDataFrame(rows, POSTING), profile_rows(dict(require_degree_filter=True)))
    assert on.first()["scrape_filter_reason"] == "degree_required"


def test_title_and_hard_no_and_age(spark, profile_rows):
    as_of = F.lit("2025-01-31").cast("timestamp")
    rows = [
        ("p", "a", "Backend role", "fine", "2025-01-10"), ("p", "b", "Software lead", "unpaid work", "2024-11-01"),
        ("p", "c", "Engineering", "internal, repaid", None),
    ]
    df = spark.createDataFrame(rows, "profile string, id string, title string, full_text string, d string")
    df = df.withColumn("posted_at", F.col("d").cast("timestamp"))
    p = profile_rows()
    assert {r["id"] for r in Q.title_filter(df, p).collect()} == {"a", "c"}
    assert {r["id"] for r in Q.hard_no_filter(df, p).collect()} == {"a", "c"}
    assert {r["id"] for r in Q.fresh_filter(df, p, as_of).collect()} == {"a", "c"}


def test_terms_with_regex_characters(spark, profile_rows):
    df = spark.createDataFrame(
        [("p", "a", "we use C++ and .NET"), ("p", "b", "c+++"), ("p", "d", "plain")], "profile string, id string, full_text string"
    )
    profiles = profile_rows(dict(hard_no_keywords=[".net", "a.b"]))
    # As a word-boundary rule has it, ".net" needs a word character in front.
    assert {r["id"] for r in Q.hard_no_filter(df, profiles).collect()} == {"a", "b", "d"}
