"""The registered queries: each has a Spark side and, where SQL can say it, an equivalent SQL text.

The driver's tables hold no postings, so fixed views turn whole tables into postings, scores,
chunks, profiles and logs. A view is written once, as SQL with two spellings for the few
functions that differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Tables whose rows are texts or become texts (profiles of customers), on which per-row work dominates.
TEXT_TABLES = {"documents", "pages", "customer"}

AS_OF = "2025-01-31 00:00:00"
AS_OF_SECONDS = 1738281600
EPOCH_2024 = 1704067200


class Spelling:
    """Functions that the two dialects spell differently."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def arr(self, *items: str) -> str:
        return f"{'array' if self.spark else 'list_value'}({', '.join(items)})"

    def words(self, *items: str) -> str:
        return self.arr(*[f"'{i}'" for i in items])

    def ts(self, seconds: str) -> str:
        if self.spark:
            return f"timestamp_seconds({seconds})"
        return f"make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT))"

    def instant(self, column: str) -> str:
        return f"CAST({column} AS TIMESTAMP)"

    def pick(self, expr: str, *items: str) -> str:
        whens = " ".join(f"WHEN {i} THEN {item}" for i, item in enumerate(items[:-1]))
        return f"CASE {expr} {whens} ELSE {items[-1]} END"


def div(expr: str, n: int) -> str:
    return f"CAST(floor(({expr}) / {n}) AS BIGINT)"


def _tenants(d: Spelling) -> str:
    n = "(r_regionkey % 5)"
    return f"""
SELECT concat('tenant_', CAST(r_regionkey AS VARCHAR(20))) AS profile,
  concat('Tenant ', r_name) AS name,
  CASE WHEN {n} = 3 THEN 'internship' ELSE 'fulltime' END AS job_type,
  concat('Works on data tools, ', lower(r_name), ' market, python and excel for the team') AS bio,
  concat('Resume: the and with python sql excel license kubernetes in at to for ', lower(r_name),
         ' cpa of ion an re under general public requires years experience') AS resume,
  CAST(NULL AS VARCHAR(20)) AS role_family,
  {d.pick(n, d.words('Backend Engineer', 'Software Engineer'), d.words('Data Analyst', 'Financial Analyst'),
          d.words('Marketing Manager', 'Growth of Software'), d.words('Software Engineering Intern'),
          d.words('Staff Engineer', 'Analyst'))} AS titles,
  {d.pick(n, d.words('the', 'und', 'python', 'kubernetes'), d.words('Excel', 'license', 'forecasting', 'und'),
          d.words('seo', 'public', 'les'), d.words('Rust', 'java'), d.words('the', 'medical'))} AS desired_skills,
  {d.pick(n, d.words('license', 'no visa'), d.words('401k', 'clearance'), d.words('und', 'c++'),
          d.words('les', 'das'), d.words('unpaid'))} AS hard_no_keywords,
  {d.pick(n, d.words('staff', 'principal'), d.words('Senior', 'manager'), d.words('the', 'intern'),
          d.words('public', 'license', 'senior'), d.words('director', 'vp'))} AS title_blocklist,
  CAST({n} % 3 AS INTEGER) AS min_yoe, CAST(5 + {n} AS INTEGER) AS max_yoe,
  CAST(20 + 5 * {n} AS INTEGER) AS max_job_age_days, ({n} % 2 = 0) AS require_degree_filter,
  CAST({n} * 2.5e0 AS DOUBLE) AS yoe, ({n} % 2 = 0) AS remote_ok,
  {d.pick(n, d.words('Austin, TX', 'Remote'), d.words('London, UK'), d.words('Berlin'), d.words('Milwaukee', 'NYC'),
          d.words('San Francisco, CA'))} AS preferred_locations,
  CAST(100000 + 10000 * {n} AS BIGINT) AS min_salary, CAST({n} * 1000 AS BIGINT) AS monthly_stipend,
  CASE WHEN {n} = 3 THEN 'paid_only' ELSE '' END AS intern_pay_preference,
  {d.words('fintech', 'health')} AS industries, {d.words('BS Computer Science')} AS education,
  {d.words('equity')} AS nice_to_haves, CAST(50 + 5 * {n} AS INTEGER) AS min_display_score,
  CASE WHEN {n} = 1 THEN 'groq' END AS provider, {d.ts(f"{EPOCH_2024} + r_regionkey * 86400")} AS updated_at
FROM {{region}}"""


def _candidates(d: Spelling) -> str:
    k = "c_custkey"
    return f"""
SELECT concat('cust_', CAST({k} AS VARCHAR(20))) AS profile, c_name AS name,
  CASE WHEN {k} % 7 = 0 THEN 'internship' ELSE 'fulltime' END AS job_type,
  concat('Based in the ', lower(c_mktsegment), ' segment. ',
    {d.pick(f"{k} % 6", "'Runs sales and CRM pipeline work.'", "'Loves Figma design systems.'",
            "'Financial modeling, CFA level two, google ads certified.'", "''", "'six sigma and lean, PMP.'",
            "'aws certified, builds APIs in Python.'")}) AS bio,
  {d.pick(f"{k} % 5", "'Managed supply chain and procurement for years; scrum master.'", "NULL",
          "'Data scientist with Tableau, dbt and Spark. MBA, Series 7.'", "'Product manager: roadmap, OKRs, Jira. CSPO'",
          "'Backend engineer: Docker, Kafka, Redis.'")} AS resume,
  {d.pick(f"{k} % 13", "'Finance'", "' design '", "'astronaut'", "NULL")} AS role_family,
  {d.pick(f"{k} % 8", d.words('Software Engineer', ' software engineer '), d.words('Data Analyst', 'BI Engineer'),
          d.words('Financial Analyst', 'FP&A Analyst'), d.words('Product Manager'), d.words('Operations Manager', 'Buyer'),
          d.words('Account Executive'), d.words('Content Lead', 'Brand Lead'), d.words('Chef'))} AS titles,
  {d.pick(f"floor({k} / 8) % 7", d.words('Python', 'python', 'Kubernetes', 'mentoring'), d.words('Excel', 'budgeting'),
          d.words('SQL', 'Tableau', 'public speaking'), d.words('wine tasting', 'Juggling', ' '), d.words('Figma', 'UX'),
          d.words('Salesforce', 'quota', 'Cold calls'), d.words('Go', 'Rust', 'Linux', 'Bash', 'Git', 'Perl', 'C', 'Zig', 'Ada'))}
    AS desired_skills,
  {d.words('unpaid', 'Clearance required')} AS hard_no_keywords,
  {d.pick(f"{k} % 3", d.words('Senior', 'senior', 'staff'), d.words('intern'), d.words('degree required', ' '))} AS title_blocklist,
  CAST(0 AS INTEGER) AS min_yoe, CAST(5 AS INTEGER) AS max_yoe, CAST(30 AS INTEGER) AS max_job_age_days,
  FALSE AS require_degree_filter,
  CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 900) ELSE 0 END AS DOUBLE) AS yoe,
  ({k} % 2 = 0) AS remote_ok,
  {d.pick(f"{k} % 3", d.words('Austin, TX', 'NYC', 'Boston'), d.words('Denver'), d.words(' '))} AS preferred_locations,
  CASE WHEN {k} % 4 = 0 THEN NULL ELSE CAST(50000 + ({k} % 100) * 1000 AS BIGINT) END AS min_salary,
  CASE WHEN {k} % 3 = 0 THEN NULL ELSE CAST(({k} % 5) * 750 AS BIGINT) END AS monthly_stipend,
  {d.pick(f"{k} % 4", "'paid_only'", "' Unpaid_OK '", "'whatever'", "NULL")} AS intern_pay_preference,
  {d.words('fintech', 'Fintech', 'health')} AS industries, {d.words('BS', ' MS ')} AS education,
  {d.words('equity')} AS nice_to_haves, CAST(60 AS INTEGER) AS min_display_score,
  CAST(NULL AS VARCHAR(20)) AS provider, {d.ts(f"{EPOCH_2024} + {k} * 60")} AS updated_at
FROM {{customer}}"""


def _postings(d: Spelling) -> str:
    k, nl = "doc_id", "chr(10)"
    title = d.pick(
        f"{div(k, 6)} % 6", "'Staff Software Engineer'", "'Backend Engineer'", "'Data Analyst'",
        "'Senior Financial Analyst'", "'Marketing Manager'", "'Software Engineering Intern'",
    )
    location = d.pick(
        f"{div(k, 36)} % 8", "'London, UK'", "'Remote'", "'N/A'", "'Austin, TX'", "'Milwaukee'",
        "'San Francisco, CA | Berlin'", "'Brussels'", "'Remote, Denmark'",
    )
    source = d.pick(f"{k} % 6", "'greenhouse'", "'lever'", "'hackernews'", "'ashby'", "'workable'", "'himalayas'")
    return f"""
SELECT *, concat('Title: ', title, {nl}, 'Company: ', company, {nl}, 'Location: ', location, {nl}, 'URL: ', url,
    {nl}, {nl}, 'Description:', {nl}, body) AS raw_text
FROM (SELECT {k}, concat('tenant_', CAST({k} % 5 AS VARCHAR(20))) AS profile,
  concat('doc_', CAST({k} AS VARCHAR(20))) AS id,
  {title} AS title, source AS company, {location} AS location,
  concat('https://jobs.example.com/', CAST({k} AS VARCHAR(20))) AS url, {source} AS source, text, lang,
  concat(text, {nl}, {nl},
    CASE WHEN {k} % 7 = 3 THEN '' ELSE concat('Requirements:', {nl}, 'Requires ', CAST({k} % 12 AS VARCHAR(20)), '+ years of experience.') END,
    CASE WHEN {k} % 4 = 1 THEN concat({nl}, '3-5 years required, at least 2 years of experience in Python. ') ELSE '' END,
    CASE WHEN {k} % 9 = 2 THEN concat({nl}, {nl}, 'A master''s degree is required. CPA required. No visa support.') ELSE '' END,
    CASE WHEN {k} % 5 = 2 THEN concat({nl}, {nl}, 'Compensation', {nl}, 'Base salary $120,000, equity.') ELSE '' END,
    CASE WHEN {k} % 3 = 1 THEN concat({nl}, {nl}, 'What we offer:', {nl}, 'Medical, dental, 401k and PTO.') ELSE '' END,
    CASE WHEN {k} % 6 = 2 AND {k} % 4 <> 0 THEN concat({nl}, {nl}, 'We are hiring a Backend Engineer or Data Analyst, remote, US.') ELSE '' END)
    AS body,
  CAST({k} % 5 AS INTEGER) AS score_attempts,
  CASE WHEN {k} % 7 = 0 THEN concat('timeout after ', CAST({k} AS VARCHAR(20)), ' ms') WHEN {k} % 7 = 1 THEN '' END AS score_error,
  {d.pick(f"{k} % 3", "'new'", "'applied'", "'skipped'")} AS status,
  ({k} % 11 <> 0 AND {k} % 13 <> 0) AS scrape_qualified,
  CASE WHEN {k} % 11 = 0 THEN concat('yoe_max: ', CAST(6 + {k} % 5 AS VARCHAR(20)), ' > 5')
       WHEN {k} % 13 = 0 AND {k} % 2 = 0 THEN 'non_us_location' ELSE '' END AS scrape_filter_reason,
  {d.ts(f"{AS_OF_SECONDS} - ({k} % 60) * 86400")} AS posted_at,
  {d.ts(f"{EPOCH_2024} + {k} * 3600")} AS created_at
FROM {{documents}}) p"""


def _scores(d: Spelling) -> str:
    k = "doc_id"
    return f"""
SELECT concat('tenant_', CAST({k} % 5 AS VARCHAR(20))) AS profile, concat('doc_', CAST({k} AS VARCHAR(20))) AS job_id,
  CAST(CASE WHEN toxic = 1 THEN 0 ELSE ({k} * 13) % 101 END AS INTEGER) AS fit_score,
  CAST(({k} * 3) % 11 AS INTEGER) AS role_fit, CAST(({k} * 5) % 11 AS INTEGER) AS stack_match,
  CAST(({k} * 7) % 11 AS INTEGER) AS seniority, CAST(({k} * 2) % 11 AS INTEGER) AS location,
  CAST(({k} * 9) % 11 AS INTEGER) AS growth,
  CASE WHEN {k} % 10 = 0 THEN NULL ELSE CAST(({k} * 4) % 11 AS INTEGER) END AS compensation,
  {d.words('good', 'fit')} AS reasons,
  CASE WHEN {k} % 19 = 0 THEN {d.words('note', 'disqualified: legacy rule')} ELSE {d.words('ok')} END AS flags,
  {d.words('rust')} AS skill_misses,
  CASE WHEN {k} % 6 = 0 THEN NULL ELSE concat('Summary ', CAST({k} AS VARCHAR(20))) END AS one_liner,
  CASE WHEN {k} % 17 = 0 THEN NULL ELSE CAST(({k} * 29) % 101 AS INTEGER) END AS ats_score,
  (toxic = 1) AS disqualified,
  CASE WHEN toxic = 1 THEN {d.pick(f"{k} % 3", "'visa'", "''", "'onsite only'")} ELSE '' END AS disqualify_reason,
  {d.ts(f"{EPOCH_2024} + {k} * 7200")} AS scored_at, quality
FROM {{labels}}"""


def _chunk_columns(d: Spelling, job: str, owner: str) -> str:
    v = "vec_id"
    key = d.pick(f"{v} % 5", "'summary'", "'responsibilities'", "'requirements'", "'compensation'", "'benefits'")
    return f"""
SELECT profile, job_id, 'hash-64/v1' AS model_name, concat('v', lpad(CAST({v} AS VARCHAR(20)), 9, '0')) AS uid, {v},
  chunk_key, CAST({v} % 5 AS INTEGER) AS chunk_order,
  concat('Section: ', chunk_key, chr(10), 'Item ', CAST({v} AS VARCHAR(20)), ' asks for ',
    {d.pick(f"{v} % 4", "'Python and SQL, remote'", "'excel budgeting; CPA required'", "'top secret clearance, unpaid'",
            "'salary, benefits and in-office work in Austin, TX'")}, '.') AS chunk_text,
  embedding, CAST(64 AS INTEGER) AS dimensions,
  {d.pick(f"{owner} % 4", "'Senior Backend Engineer'", "'Data Analyst'", "'Software Engineering Intern'", "'Marketing Manager'")} AS title,
  concat('src', CAST({owner} % 20 AS VARCHAR(20))) AS company,
  {d.pick(f"{owner} % 3", "'greenhouse'", "'lever'", "'hackernews'")} AS source,
  concat('https://jobs.example.com/', job_id) AS url,
  {d.ts(f"{EPOCH_2024} + {v} * 30")} AS created_at
FROM (SELECT {v}, embedding, label, {key} AS chunk_key, concat('tenant_', CAST({owner} % 5 AS VARCHAR(20))) AS profile,
        {job} AS job_id FROM {{embeddings}}) e"""


def _chunks(d: Spelling) -> str:
    owner = div("vec_id", 5)
    return _chunk_columns(d, f"concat('doc_', CAST({owner} AS VARCHAR(20)))", owner)


def _grouped_chunks(d: Spelling) -> str:
    return _chunk_columns(d, "concat('grp_', CAST(label AS VARCHAR(20)))", "label")


def _requests(d: Spelling) -> str:
    owner = div("vec_id", 5)
    text = d.pick(
        "vec_id % 5", "'backend engineer python sql'", "'salary and benefits for an analyst'", "'   '",
        "'remote dental vision plan'", "NULL",
    )
    return f"""
SELECT CAST(vec_id AS VARCHAR(20)) AS query_id, concat('tenant_', CAST({owner} % 5 AS VARCHAR(20))) AS profile,
  {text} AS user_text, coalesce({text}, '') AS query_text, embedding AS query_vec
FROM {{embeddings}}"""


def _grouped_requests(d: Spelling) -> str:
    return _requests(d).replace(f"CAST({div('vec_id', 5)} % 5", "CAST(label % 5")


def _runs(d: Spelling) -> str:
    return f"""
SELECT concat('run_', lpad(CAST(event_id AS VARCHAR(20)), 9, '0')) AS run_id,
  concat('tenant_', CAST(user_id % 5 AS VARCHAR(20))) AS profile, {d.instant('ts')} AS started_at,
  {d.pick("event_id % 2", "'pipeline'", "'manual'")} AS source, CAST(event_id % 50 AS INTEGER) AS jobs_scraped,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN event_type = 'error' THEN {d.words('  HTTP 500 from the board of a company with a rather long name, retried three times ', 'second')}
       WHEN event_type = 'click' THEN {d.words('short')} ELSE {d.words('x')} END AS errors,
  (event_type = 'view') AS no_errors
FROM {{events}}"""


def _request_log(d: Spelling) -> str:
    return f"""
SELECT CASE WHEN user_id % 3 = 0 THEN 'groq' WHEN user_id % 5 = 1 THEN 'gemini' ELSE 'anthropic' END AS provider,
  event_id AS request_id, {d.instant('ts')} AS ts, CAST(floor(value * 100) AS BIGINT) AS tokens
FROM {{events}}"""


def _status_changes(d: Spelling) -> str:
    return f"""
SELECT concat('tenant_', CAST(user_id % 5 AS VARCHAR(20))) AS profile, concat('doc_', CAST(user_id AS VARCHAR(20))) AS id,
  CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'applied' WHEN 'signup' THEN 'applied' ELSE 'skipped' END AS new_status,
  {d.instant('ts')} AS changed_at, event_id AS change_id
FROM {{events}}"""


def _attempts(d: Spelling) -> str:
    return f"""
SELECT concat('tenant_', CAST(user_id % 5 AS VARCHAR(20))) AS profile, concat('doc_', CAST(user_id AS VARCHAR(20))) AS id,
  {d.instant('ts')} AS tried_at,
  CASE WHEN event_type = 'error' THEN repeat(concat('E', CAST(event_id AS VARCHAR(20)), ' '), 120) END AS error
FROM {{events}}"""


def _companies(d: Spelling) -> str:
    return f"""
SELECT concat('tenant_', CAST(s_suppkey % 5 AS VARCHAR(20))) AS profile,
  {d.pick(f"{div('s_suppkey', 5)} % 4", "'greenhouse'", "'lever'", "'ashby'", "'workable'")} AS source,
  concat('nation_', CAST(s_suppkey % 40 AS VARCHAR(20))) AS slug, s_name AS company_name,
  {d.ts(f"{EPOCH_2024} + (s_suppkey * 977) % 100003")} AS discovered_at
FROM {{supplier}}"""


def _listed_companies(d: Spelling) -> str:
    return f"""
SELECT concat('tenant_', CAST(n_nationkey % 5 AS VARCHAR(20))) AS profile,
  {d.pick(f"{div('n_nationkey', 5)} % 4", "'greenhouse'", "'lever'", "'ashby'", "'workable'")} AS source,
  lower(n_name) AS slug, CAST(n_nationkey AS BIGINT) AS position
FROM {{nation}}"""


VIEWS: dict[str, Callable[[Spelling], str]] = {
    "tenants": _tenants,
    "candidates": _candidates,
    "postings": _postings,
    "scores": _scores,
    "chunks": _chunks,
    "grouped_chunks": _grouped_chunks,
    "requests": _requests,
    "grouped_requests": _grouped_requests,
    "runs": _runs,
    "request_log": _request_log,
    "status_changes": _status_changes,
    "attempts": _attempts,
    "companies": _companies,
    "listed_companies": _listed_companies,
}


class Inputs:
    """Tables and views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in TEXT_TABLES else table
        if name in VIEWS:
            sql = VIEWS[name](Spelling(spark=True)).replace("VARCHAR(20)", "STRING")
            used = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", sql)}
            return self.spark.sql(sql, **used)
        raise AttributeError(name)

    @cached_property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp")


def oracle_text(sql: str) -> str:
    """SQL with the views it names put in front as common table expressions."""
    needed = [v for v in VIEWS if re.search(rf"\bv_{v}\b", sql)]
    parts = []
    for view in needed:
        body = VIEWS[view](Spelling(spark=False)).replace("VARCHAR(20)", "VARCHAR")
        parts.append(f"v_{view} AS ({re.sub(r'[{](\w+)[}]', r'\1', body)})")
    text = sql.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return build

    return register


# ---- pieces of oracle SQL ------------------------------------------------------------------


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def any_in(expr: str, values) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(v)})" for v in values) + ")"


def count_in(expr: str, values) -> str:
    return "(" + " + ".join(f"contains({expr}, {quoted(v)})::BIGINT" for v in values) + ")"


def trimmed(expr: str) -> str:
    return f"trim({expr}, e' \\t\\n\\r')"


def words_pattern(values) -> str:
    """Whole-word test for RE2, whose own word boundary knows ASCII only."""
    body = "|".join(re.escape(v).replace("\\ ", " ") for v in values)
    return f"(^|[^\\p{{L}}\\p{{N}}_])({body})($|[^\\p{{L}}\\p{{N}}_])"


def round4_sql(expr: str) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE) * 10000e0, 0) / 10000e0)"
