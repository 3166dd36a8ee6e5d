"""Qualification rules over all postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.catalog.core import AS_OF, Inputs, any_in, query, quoted, words_pattern
from siftwork.catalog.text import YOE_LIST_SQL
from siftwork.functions import predicates as P
from siftwork.operators import qualify as Q

JOINED = "v_postings p JOIN v_tenants t ON t.profile = p.profile"


@query(
    "title_matches",
    f"""
SELECT id FROM {JOINED} WHERE len(list_filter(flatten(list_transform(titles, lambda x: string_split(lower(x), ' '))),
  lambda w: w NOT IN ({", ".join(quoted(w) for w in vocab.TITLE_STOPWORDS)}) AND contains(lower(title), w))) > 0
""",
)
def _(t: Inputs) -> DataFrame:
    return Q.title_filter(t.postings, t.tenants).select("id")


def _word_hits(terms: str, text: str) -> str:
    """Terms of a list found as whole words in a text, Unicode rules."""
    edge = "[^\\p{L}\\p{N}_]"
    return (
        f"list_filter({terms}, lambda k: regexp_matches({text}, concat('(^|{edge})', "
        f"regexp_replace(lower(k), '([+.])', '\\\\\\1', 'g'), CASE WHEN regexp_matches(k, '[\\p{{L}}\\p{{N}}_]$') THEN "
        f"'($|{edge})' ELSE '[\\p{{L}}\\p{{N}}_]' END)))"
    )


@query("hard_no_keywords", f"SELECT id FROM {JOINED} WHERE len({_word_hits('hard_no_keywords', 'lower(raw_text)')}) = 0")
def _(t: Inputs) -> DataFrame:
    return Q.hard_no_filter(t.postings, t.tenants, "raw_text").select("id")


@query(
    "posted_within",
    f"SELECT id FROM {JOINED} WHERE posted_at >= TIMESTAMP '{AS_OF}' - to_days(max_job_age_days)",
)
def _(t: Inputs) -> DataFrame:
    return Q.fresh_filter(t.postings, t.tenants, t.as_of).select("id")


_SEARCHED = "lower(CASE WHEN source = 'hackernews' THEN concat(title, ' ', raw_text) ELSE title END)"
_BLOCKED_SQL = f"lower({_word_hits('title_blocklist', _SEARCHED)}[1])"


@query("title_blocklist", f"SELECT id, {_BLOCKED_SQL} AS term FROM {JOINED}")
def _(t: Inputs) -> DataFrame:
    joined = Q.with_rules(t.postings, t.tenants)
    c = F.col
    searched = F.when(c("source") == "hackernews", F.concat("title", F.lit(" "), "raw_text")).otherwise(c("title"))
    return joined.select("id", P.blocked_term(searched, c("block_any"), c("block_terms"), c("block_patterns")).alias("term"))


_YOE_REASON_SQL = """CASE WHEN list_max(years) > max_yoe THEN concat('yoe_max: ', list_max(years), ' > ', max_yoe)
  WHEN list_min(years) < min_yoe THEN concat('yoe_min: ', list_min(years), ' < ', min_yoe) END"""


@query("yoe_range", f"SELECT id, {_YOE_REASON_SQL} AS reason FROM (SELECT *, {YOE_LIST_SQL} AS years FROM {JOINED}) x")
def _(t: Inputs) -> DataFrame:
    joined = Q.with_rules(t.postings, t.tenants)
    years = P.extract_yoe(F.col("raw_text"))
    return joined.select("id", P.yoe_reason(years, F.col("rule_min_yoe"), F.col("rule_max_yoe")).alias("reason"))


def _intent_sql(text: str) -> str:
    """Keyword within 50 words of the first occurrence of each signal."""
    tests = []
    for s in vocab.HIRING_SIGNALS:
        at = f"strpos({text}, {quoted(s)})"
        n = f"len(list_filter(string_split_regex(substr({text}, 1, {at} - 1), '\\s+'), lambda w: w <> ''))"
        words = f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"
        window = f"array_to_string(({words})[greatest(0, {n} - 50) + 1 : {n} + 50], ' ')"
        tests.append(
            f"({at} > 0 AND len(list_filter(list_concat(titles, desired_skills), "
            f"lambda k: contains({window}, lower(k)))) > 0)"
        )
    return "(" + " OR ".join(tests) + ")"


@query("hiring_intent", f"SELECT id, {_intent_sql('low')} AS found FROM (SELECT *, lower(raw_text) AS low FROM {JOINED}) x")
def _(t: Inputs) -> DataFrame:
    joined = Q.with_rules(t.postings, t.tenants)
    return joined.select("id", P.hiring_intent(F.col("raw_text"), F.col("intent_keywords")).alias("found"))


_DEGREE_SQL = "(" + " OR ".join(f"regexp_matches(raw_text, {quoted('(?i)' + p)})" for p in vocab.DEGREE_PATTERNS) + ")"


@query("requires_advanced_degree", f"SELECT id, {_DEGREE_SQL} AS required FROM v_postings")
def _(t: Inputs) -> DataFrame:
    return t.postings.select("id", P.requires_advanced_degree(F.col("raw_text")).alias("required"))


def _us_signal_sql(text: str) -> str:
    states = "|".join(vocab.US_STATE_CODES)
    low = f"lower({text})"
    code = f"(?:,\\s*|;\\s*|\\|\\s*|^|[^\\p{{L}}\\p{{N}}_])({states})($|[^\\p{{L}}\\p{{N}}_])"
    return (
        f"(contains({low}, 'united states') OR contains({low}, ' usa') OR regexp_matches({text}, {quoted(words_pattern(['US']))}) "
        f"OR regexp_matches({text}, {quoted(code)}) OR {any_in(low, vocab.US_STATE_NAMES)} "
        f"OR regexp_matches({low}, {quoted(words_pattern(vocab.US_CITIES))}))"
    )


_US_LOCATION_SQL = f"""CASE WHEN lower(trim(location)) IN ({", ".join(quoted(p) for p in vocab.LOCATION_PLACEHOLDERS)}) THEN TRUE
  WHEN {any_in('lower(location)', vocab.NON_US_PLACES)} THEN FALSE WHEN contains(lower(location), 'remote') THEN TRUE
  ELSE {_us_signal_sql('location')} END"""
_US_TEXT_SQL = (
    f"((contains(lower(raw_text), 'remote') AND NOT {any_in('lower(raw_text)', vocab.NON_US_PLACES_IN_TEXT)}) "
    f"OR {_us_signal_sql('raw_text')})"
)


@query("is_us_location", f"SELECT id, location, {_US_LOCATION_SQL} AS in_us FROM v_postings")
def _(t: Inputs) -> DataFrame:
    return t.postings.select("id", "location", P.is_us_location(F.col("location")).alias("in_us"))


@query("us_or_remote_text", f"SELECT id, {_US_TEXT_SQL} AS in_us FROM v_postings")
def _(t: Inputs) -> DataFrame:
    return t.postings.select("id", P.us_or_remote_text(F.col("raw_text")).alias("in_us"))


REASON_SQL = f"""
SELECT profile, id, source, coalesce(concat('title_blocklist: ', blocked), yoe, intent, degree, place, '') AS scrape_filter_reason
FROM (SELECT p.profile, id, source, nullif({_BLOCKED_SQL}, NULL) AS blocked, {_YOE_REASON_SQL} AS yoe,
  CASE WHEN source = 'hackernews' AND NOT {_intent_sql('low')} THEN 'hiring_intent_not_found' END AS intent,
  CASE WHEN require_degree_filter AND {_DEGREE_SQL} THEN 'degree_required' END AS degree,
  CASE WHEN NOT (CASE WHEN source = 'hackernews' THEN {_US_TEXT_SQL} ELSE {_US_LOCATION_SQL} END) THEN 'non_us_location' END AS place
  FROM (SELECT *, lower(raw_text) AS low, {YOE_LIST_SQL} AS years FROM v_postings) p JOIN v_tenants t ON t.profile = p.profile) x
"""
# concat skips nulls in this dialect, so the blocklist part is guarded.
REASON_SQL = REASON_SQL.replace(
    "concat('title_blocklist: ', blocked)", "CASE WHEN blocked IS NOT NULL THEN concat('title_blocklist: ', blocked) END"
)


@query(
    "qualify",
    f"SELECT id, scrape_filter_reason = '' AS scrape_qualified, scrape_filter_reason FROM ({REASON_SQL}) q",
)
def _(t: Inputs) -> DataFrame:
    rows = Q.qualify(t.postings.drop("scrape_filter_reason", "scrape_qualified"), t.tenants, "raw_text", "location")
    return rows.select("id", "scrape_qualified", "scrape_filter_reason")


@query(
    "qualification_funnel",
    f"""
SELECT source, split_part(scrape_filter_reason, ':', 1) AS reason, count(*) AS postings FROM ({REASON_SQL}) q GROUP BY 1, 2
""",
)
def _(t: Inputs) -> DataFrame:
    rows = Q.qualify(t.postings.drop("scrape_filter_reason", "scrape_qualified"), t.tenants, "raw_text", "location")
    reason = F.substring_index("scrape_filter_reason", ":", 1)
    return rows.groupBy("source", reason.alias("reason")).agg(F.count("*").alias("postings"))


@query(
    "effective_location",
    f"""
SELECT id, CASE WHEN workplace = 'remote' AND NOT {any_in('lower(location)', vocab.NON_US_PLACES)} THEN 'Remote' ELSE location END AS place
FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE '' END AS workplace FROM v_postings) p
""",
)
def _(t: Inputs) -> DataFrame:
    k = F.col("doc_id") % 3
    workplace = F.when(k == 0, "remote").when(k == 1, "hybrid").otherwise("")
    return t.postings.select("id", P.effective_location(F.col("location"), workplace).alias("place"))
