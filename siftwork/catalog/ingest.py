"""Payload normalization, table changes and the batch twins of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.catalog.core import AS_OF, AS_OF_SECONDS, ORACLES, Inputs, any_in, query, quoted, trimmed
from siftwork.catalog.filters import REASON_SQL
from siftwork.functions.strings import string_array
from siftwork.plans.ingest import admit_early, admitted, judge, scrape_stats
from siftwork.session import shared_dir
from siftwork.sources import ledger, statuses
from siftwork.sources import payloads as L
from siftwork.sources import profiles as P
from siftwork.sources import tables as T
from siftwork.streaming.ingest import current_status, funnel_by_hour

# ---- payloads made from documents ----------------------------------------------------------
# Boards land page by page; here ten postings make a page, and every document is on one.


def _pages(rows: DataFrame, posting: Column, wrap: str | None) -> DataFrame:
    page = F.floor(F.col("doc_id") / 60).alias("page")
    groups = rows.select("profile", "company", page, posting.alias("p")).groupBy("profile", "company", "page")
    listed = groups.agg(F.collect_list("p").alias("postings"))
    payload = F.to_json("postings") if wrap is None else F.to_json(F.struct(F.col("postings").alias(wrap)))
    fetched = F.timestamp_seconds(F.lit(AS_OF_SECONDS) + F.col("page"))
    return listed.select("profile", "company", fetched.alias("fetched_at"), payload.alias("payload"))


def _of_source(t: Inputs, source: str) -> DataFrame:
    return t.postings.where(F.col("source") == source)


def _id() -> Column:
    return F.col("doc_id").cast("string").alias("id")


def _html(text: Column) -> Column:
    return F.concat(F.lit("<p>"), text, F.lit("</p><script>x()</script>"))


def greenhouse_raw(t: Inputs) -> DataFrame:
    escaped = F.concat(F.lit("&lt;p&gt;"), F.col("text"), F.lit("&lt;/p&gt; R&amp;amp;D"))
    posting = F.struct(
        _id(), F.col("title"), F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at"),
        F.when(F.col("doc_id") % 24 != 0, F.struct(F.col("location").alias("name"))).alias("location"),
        F.col("url").alias("absolute_url"),
        F.when(F.col("doc_id") % 4 != 0, escaped).alias("content"), escaped.alias("description"),
    )
    return _pages(_of_source(t, "greenhouse"), posting, "jobs").withColumn("source", F.lit("greenhouse"))


def lever_raw(t: Inputs) -> DataFrame:
    posting = F.struct(
        _id(), F.col("title").alias("text"), (F.unix_seconds("posted_at") * 1000).alias("createdAt"),
        F.struct(F.col("location").alias("location")).alias("categories"),
        F.when(F.col("doc_id") % 4 == 1, "remote").alias("workplaceType"), F.col("url").alias("hostedUrl"),
        _html(F.col("text")).alias("description"),
        F.array(F.struct(F.lit("<li>Python</li>").alias("content")), F.struct(F.lit("<li>SQL</li>").alias("content"))).alias("lists"),
    )
    return _pages(_of_source(t, "lever"), posting, None).withColumn("source", F.lit("lever"))


def ashby_raw(t: Inputs) -> DataFrame:
    k = F.col("doc_id") % 4
    posting = F.struct(
        F.when(k != 1, F.col("doc_id").cast("string")).alias("id"), F.col("title"),
        F.when(k == 3, F.col("location")).alias("location"), F.when(k == 1, F.lit("")).alias("locationName"),
        F.array(F.struct(F.col("location").alias("location")), F.struct(F.lit("Remote").alias("location"))).alias("secondaryLocations"),
        F.col("url").alias("jobUrl"), _html(F.col("text")).alias("descriptionHtml"),
        F.when(k == 3, F.col("text")).alias("descriptionPlain"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("publishedDate"),
        (F.col("doc_id") % 10 != 3).alias("isListed"),
    )
    return _pages(_of_source(t, "ashby"), posting, "jobPostings").withColumn("source", F.lit("ashby"))


def workable_raw(t: Inputs) -> DataFrame:
    k = F.col("doc_id") % 5
    place = F.struct(F.lit("Austin").alias("city"), F.lit("").alias("region"), F.lit("TX").alias("state"), F.col("location").alias("country"))
    posting = F.struct(
        F.when(k != 0, F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("sc"), "doc_id").alias("shortcode"),
        F.col("title"), (k == 4).alias("telecommuting"),
        F.when(k == 3, place).alias("location"), F.when(k == 2, F.col("location")).alias("city"),
        F.when(k == 2, F.lit("US")).alias("country"),
        F.array(F.struct(F.col("location").alias("city"), F.lit("Land").alias("country"))).alias("locations"),
        F.col("url").alias("shortlink"), _html(F.col("text")).alias("description"),
        F.unix_seconds("posted_at").cast("string").alias("created_at"),
        F.when(k == 1, F.lit("Sales")).alias("department"), F.lit("Mid").alias("experience"),
    )
    return _pages(_of_source(t, "workable"), posting, "results").withColumn("source", F.lit("workable"))


def himalayas_raw(t: Inputs) -> DataFrame:
    k = F.col("doc_id") % 4
    company = F.struct(F.struct(F.upper("company").alias("name")).alias("company"))
    posting = F.struct(
        F.when(k == 1, F.col("doc_id").cast("string")).alias("id"), F.col("title"),
        F.when(k == 3, F.col("company")).alias("companyName"), company["company"].alias("company"),
        F.when(k == 3, F.col("location")).alias("location"),
        F.when(F.col("doc_id") % 12 == 5, F.array(F.col("location"), F.lit("USA"))).alias("locationRestrictions"),
        F.when(k == 3, F.col("url")).alias("applicationLink"), F.col("url").alias("url"),
        _html(F.col("text")).alias("description"), F.unix_seconds("posted_at").alias("pubDate"),
    )
    return _pages(_of_source(t, "himalayas"), posting, "jobs").withColumn("source", F.lit("himalayas"))


def thread_raw(t: Inputs) -> DataFrame:
    """Two threads per profile; its documents are the comments of the newer one, in id order."""
    rows = _of_source(t, "hackernews")
    base = rows.select("profile").distinct()

    def hit(id_: int, days_old: int, author: str) -> Column:
        return F.struct(
            F.lit(str(id_)).alias("objectID"), F.lit(f"Who is hiring {id_}").alias("title"), F.lit(author).alias("author"),
            F.lit(AS_OF_SECONDS - days_old * 86400).alias("created_at_i"),
        )

    search = F.to_json(
        F.struct(F.array(hit(71, 40, "whoishiring"), hit(72, 9, "whoishiring"), hit(73, 1, "someone")).alias("hits"))
    )
    # A thread item lists a thousand comments of a profile at most; a profile has as many items as it needs.
    listed = rows.groupBy("profile", (F.col("doc_id") / 1000).cast("bigint").alias("item"))
    kids = listed.agg(F.array_sort(F.collect_list("doc_id")).alias("kids"))
    thread = F.to_json(F.struct(F.lit(72).alias("id"), F.col("kids")))
    comment = F.to_json(F.struct(F.col("doc_id").alias("id"), _html(F.concat(F.col("title"), F.lit("\n"), F.col("body"))).alias("text")))
    parts = [
        base.select("profile", search.alias("payload")), kids.select("profile", thread.alias("payload")),
        rows.select("profile", comment.alias("payload")),
    ]
    fetched = F.timestamp_seconds(F.lit(AS_OF_SECONDS))
    return L.union_postings(parts).select(
        "profile", F.lit("hackernews").alias("source"), F.lit("").alias("company"), fetched.alias("fetched_at"), "payload"
    )


RAW_COLUMNS = ["profile", "source", "company", "fetched_at", "payload"]


def all_raw(t: Inputs) -> DataFrame:
    parts = [greenhouse_raw(t), lever_raw(t), ashby_raw(t), workable_raw(t), himalayas_raw(t), thread_raw(t)]
    return L.union_postings([p.select(*RAW_COLUMNS) for p in parts])


def _normalized_sql(source: str, **fields: str) -> str:
    day = "epoch_us(posted_at) // 1000000"
    values = {
        "id": f"concat('{source}_', doc_id)", "company": "company", "location": "location", "filter_location": "location",
        "url": "url", "description": trimmed("text"), "posted_s": day, **fields,
    }
    cleaned = (
        "array_to_string(list_filter(list_transform(string_split(%s, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))"
    )
    values["description"] = cleaned % values["description"] if source != "ashby" else values["description"]
    return f"""SELECT profile, {", ".join(f"{v} AS {k}" for k, v in values.items())}, title FROM v_postings WHERE source = '{source}'"""


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select(
        "profile", "id", "title", "company", "location", "filter_location", "url", "description",
        F.unix_seconds("posted_at").alias("posted_s"),
    )


def _fields_sql(source: str, where: str = "TRUE", **fields: str) -> str:
    return (
        f"SELECT profile, id, title, company, location, filter_location, url, description, posted_s "
        f"FROM ({_normalized_sql(source, **fields)}) n WHERE {where}"
    )


_GH_LOCATION = "CASE WHEN doc_id % 24 = 0 THEN 'Unknown' ELSE location END"


@query(
    "normalize_greenhouse",
    _fields_sql("greenhouse", location=_GH_LOCATION, filter_location=_GH_LOCATION, description="concat(text, ' R&D')"),
)
def _(t: Inputs) -> DataFrame:
    return _fields(L.normalize_greenhouse(greenhouse_raw(t)))


@query(
    "normalize_lever",
    _fields_sql(
        "lever",
        filter_location=f"CASE WHEN doc_id % 4 = 1 AND NOT {any_in('lower(location)', vocab.NON_US_PLACES)} THEN 'Remote' ELSE location END",
        description="concat(text, ' Python SQL')",
    ),
)
def _(t: Inputs) -> DataFrame:
    return _fields(L.normalize_lever(lever_raw(t)))


_ASHBY_PLACE = "CASE WHEN doc_id % 4 = 3 THEN location ELSE concat(location, ' | Remote') END"
_ASHBY_TEXT = (
    "CASE WHEN doc_id % 4 = 3 THEN text ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), "
    "lambda l: trim(l)), lambda l: l <> ''), chr(10)) END"
)


@query(
    "normalize_ashby",
    "SELECT * FROM (" + _fields_sql(
        "ashby", id="concat('ashby_', CASE WHEN doc_id % 4 = 1 THEN url ELSE CAST(doc_id AS VARCHAR) END)", location=_ASHBY_PLACE,
        filter_location=_ASHBY_PLACE, description=_ASHBY_TEXT, posted_s="epoch_us(date_trunc('day', posted_at)) // 1000000",
    ) + ") a WHERE CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) % 10 <> 3",
)
def _(t: Inputs) -> DataFrame:
    return _fields(L.normalize_ashby(ashby_raw(t)))


_WORK_PLACE = """CASE doc_id % 5 WHEN 4 THEN 'Remote' WHEN 3 THEN concat('Austin, TX, ', location) WHEN 2 THEN concat(location, ', US')
  ELSE concat(location, ', Land') END"""


@query(
    "normalize_workable",
    _fields_sql(
        "workable", id="concat('workable_', CASE WHEN doc_id % 5 = 0 THEN concat('sc', doc_id) ELSE CAST(doc_id AS VARCHAR) END)",
        location=_WORK_PLACE, filter_location=_WORK_PLACE,
        description="concat(text, CASE WHEN doc_id % 5 = 1 THEN concat(chr(10), 'Department: Sales') ELSE '' END, chr(10), 'Experience: Mid')",
    ),
)
def _(t: Inputs) -> DataFrame:
    return _fields(L.normalize_workable(workable_raw(t)))


_HIM_COMPANY = "CASE WHEN doc_id % 4 = 3 THEN company ELSE upper(company) END"
_HIM_PLACE = "CASE WHEN doc_id % 4 = 3 THEN location WHEN doc_id % 12 = 5 THEN concat(location, ' | USA') ELSE 'Remote' END"


@query(
    "normalize_himalayas",
    _fields_sql(
        "himalayas", id="concat('himalayas_', CASE WHEN doc_id % 4 = 1 THEN CAST(doc_id AS VARCHAR) ELSE url END)", company=_HIM_COMPANY,
        location=_HIM_PLACE, filter_location=_HIM_PLACE,
    ),
)
def _(t: Inputs) -> DataFrame:
    return _fields(L.normalize_himalayas(himalayas_raw(t)))


_THREAD_SQL = f"""
WITH c AS (SELECT profile, doc_id, concat(title, chr(10), array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(l)),
    lambda l: l <> ''), chr(10))) AS text, title FROM v_postings WHERE source = 'hackernews')
SELECT profile, concat('hackernews_', doc_id) AS id, title, concat('https://news.ycombinator.com/item?id=', doc_id) AS url, text AS description
FROM c WHERE length(text) >= {vocab.MIN_COMMENT_CHARS}
"""


@query("normalize_thread", _THREAD_SQL)
def _(t: Inputs) -> DataFrame:
    return L.normalize_thread(thread_raw(t), t.as_of).select("profile", "id", "title", "url", "description")


_ALL_SQL = " UNION ALL ".join(
    f"SELECT profile, '{name}' AS source, id, title, company, location, url, description FROM ({sql}) x"
    for name, sql in [
        *[(name, ORACLES[f"normalize_{name}"]) for name in ("greenhouse", "lever", "ashby", "workable", "himalayas")],
        ("hackernews", f"SELECT *, 'Unknown' AS company, 'Unknown' AS location FROM ({ORACLES['normalize_thread']}) y"),
    ]
)


@query("normalize_all_sources", _ALL_SQL)
def _(t: Inputs) -> DataFrame:
    """All sources of one stored landing, the boards in one pass."""
    path = f"{shared_dir(t.spark)}/landing-{uuid.uuid4().hex}"
    all_raw(t).write.parquet(path)
    rows = L.normalize_all(t.spark.read.parquet(path), t.as_of)
    return rows.select("profile", "source", "id", "title", "company", "location", "url", "description")


# ---- single fields of the payloads ---------------------------------------------------------


@query(
    "ashby_location",
    f"SELECT url, {_ASHBY_PLACE} AS place FROM v_postings WHERE source = 'ashby'",
)
def _(t: Inputs) -> DataFrame:
    rows = L.exploded(ashby_raw(t), "ashby", L.ASHBY, lambda j: j["jobPostings"])
    place = L.ashby_location(F.col("p.location"), F.col("p.locationName"), F.col("p.secondaryLocations"))
    return rows.select(F.col("p.jobUrl").alias("url"), place.alias("place"))


@query("workable_location", f"SELECT url, {_WORK_PLACE} AS place FROM v_postings WHERE source = 'workable'")
def _(t: Inputs) -> DataFrame:
    rows = L.exploded(workable_raw(t), "workable", L.WORKABLE, lambda j: j["results"])
    return rows.select(F.col("p.shortlink").alias("url"), L.workable_location(F.col("p")).alias("place"))


@query(
    "himalayas_fields",
    f"SELECT url, {_HIM_COMPANY} AS company, {_HIM_PLACE} AS place FROM v_postings WHERE source = 'himalayas'",
)
def _(t: Inputs) -> DataFrame:
    rows = L.exploded(himalayas_raw(t), "himalayas", L.HIMALAYAS, lambda j: j["jobs"])
    return rows.select(
        L.himalayas_url(F.col("p.applicationLink"), F.col("p.url"), F.col("p.guid")).alias("url"),
        L.himalayas_company(F.col("p.companyName"), F.col("p.company")).alias("company"),
        L.himalayas_location(F.col("p.location"), F.col("p.locationRestrictions")).alias("place"),
    )


_CLEAN = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))"


@query(
    "board_descriptions",
    f"""SELECT url, {_ASHBY_TEXT} AS description FROM v_postings WHERE source = 'ashby' UNION ALL
SELECT url, concat({_CLEAN}, CASE WHEN doc_id % 5 = 1 THEN concat(chr(10), 'Department: Sales') ELSE '' END, chr(10), 'Experience: Mid')
FROM v_postings WHERE source = 'workable'""",
)
def _(t: Inputs) -> DataFrame:
    ashby = L.exploded(ashby_raw(t), "ashby", L.ASHBY, lambda j: j["jobPostings"])
    workable = L.exploded(workable_raw(t), "workable", L.WORKABLE, lambda j: j["results"])
    first = ashby.select(
        F.col("p.jobUrl").alias("url"),
        L.ashby_description(F.col("p.descriptionPlain"), F.col("p.descriptionHtml")).alias("description"),
    )
    second = workable.select(F.col("p.shortlink").alias("url"), L.workable_description(F.col("p")).alias("description"))
    return first.unionByName(second)


# ---- ingest --------------------------------------------------------------------------------

_JUDGED = f"""
WITH reason AS ({REASON_SQL}),
j AS (SELECT p.profile, p.source, p.id, posted_at >= TIMESTAMP '{AS_OF}' - to_days(max_job_age_days) AS fresh,
  len(list_filter(flatten(list_transform(titles, lambda x: string_split(lower(x), ' '))),
    lambda w: w NOT IN ({", ".join(quoted(w) for w in vocab.TITLE_STOPWORDS)}) AND contains(lower(title), w))) > 0 AS match,
  len(list_filter(hard_no_keywords, lambda k: regexp_matches(lower(raw_text), concat('(^|[^\\p{{L}}\\p{{N}}_])', regexp_replace(lower(k), '([+.])', '\\\\\\1', 'g'),
    CASE WHEN regexp_matches(k, '[\\p{{L}}\\p{{N}}_]$') THEN '($|[^\\p{{L}}\\p{{N}}_])' ELSE '[\\p{{L}}\\p{{N}}_]' END)))) > 0 AS hard_no, r.scrape_filter_reason AS reason
  FROM v_postings p JOIN v_tenants t ON t.profile = p.profile JOIN reason r ON r.id = p.id)"""


def _as_normalized(t: Inputs) -> DataFrame:
    """Postings in the shape the normalizers give, texts whole."""
    return t.postings.select(
        "profile", "source", "id", "title", "company", "location", F.col("location").alias("filter_location"), "url",
        F.col("body").alias("description"), F.col("raw_text").alias("full_text"), "raw_text", "posted_at",
        F.col("created_at").alias("fetched_at"),
    )


@query(
    "admitted",
    _JUDGED + " SELECT id, reason = '' AS scrape_qualified, reason AS scrape_filter_reason FROM j WHERE fresh AND match AND NOT hard_no",
)
def _(t: Inputs) -> DataFrame:
    rows = admitted(judge(_as_normalized(t), t.tenants, t.as_of))
    return rows.select("id", "scrape_qualified", "scrape_filter_reason")


@query(
    "admit_early",
    _JUDGED + " SELECT id, reason = '' AS scrape_qualified, reason AS scrape_filter_reason FROM j WHERE fresh AND match AND NOT hard_no",
)
def _(t: Inputs) -> DataFrame:
    rows = admit_early(_as_normalized(t), t.tenants, t.as_of)
    return rows.select("id", "scrape_qualified", "scrape_filter_reason")


@query(
    "scrape_stats",
    _JUDGED + """, k AS (SELECT j.*, s.job_id IS NULL AS is_new FROM j LEFT JOIN v_scores s ON s.job_id = j.id)
SELECT profile, source, count(*) FILTER (fresh AND (match OR source = 'hackernews')) AS jobs_scraped,
  count(*) FILTER (fresh AND CASE WHEN match THEN hard_no OR reason <> '' ELSE source IN ('hackernews', 'himalayas') END) AS jobs_filtered,
  count(DISTINCT CASE WHEN fresh AND match AND NOT hard_no AND reason = '' AND is_new THEN id END) AS jobs_saved
FROM k GROUP BY GROUPING SETS ((profile, source), (profile))""",
)
def _(t: Inputs) -> DataFrame:
    known = t.scores.select("profile", F.col("job_id").alias("id")).join(t.postings.select("profile", "id", "source"), ["profile", "id"])
    return scrape_stats(judge(_as_normalized(t), t.tenants, t.as_of), known).drop("is_total")


@query("ingest_all_sources")
def _(t: Inputs) -> DataFrame:
    """All six payload shapes to storable postings."""
    from siftwork.plans.ingest import ingest

    profiles = t.tenants.withColumn(
        "sources_enabled", F.struct(*[F.lit(True).alias(s) for s in vocab.SOURCE_ENABLED_BY_DEFAULT])
    )
    rows = ingest(all_raw(t), profiles, t.as_of)
    return rows.select("profile", "source", "id", "title", "location", "scrape_qualified", "scrape_filter_reason", "raw_text")


# ---- profile configurations ----------------------------------------------------------------


@query(
    "profiles_from_config",
    """SELECT profile, name, job_type, array_to_string(titles, '|') AS titles, CASE WHEN c % 2 = 0 THEN 0 ELSE 1 END AS min_yoe,
  CASE WHEN c % 3 = 0 THEN 99 ELSE 7 END AS max_yoe, 30 AS max_job_age_days, CASE WHEN c % 2 = 0 THEN TRUE ELSE remote_ok END AS remote_ok,
  60 AS min_display_score, CASE WHEN c % 2 = 0 THEN 0.3e0 ELSE 0.5e0 END AS w_role, c % 5 <> 1 AS greenhouse_on, c % 4 = 0 AS hn_on
FROM (SELECT *, CAST(regexp_extract(profile, '([0-9]+)$', 1) AS BIGINT) AS c FROM v_candidates) x""",
)
def _(t: Inputs) -> DataFrame:
    rows = P.profiles_from_config(_configs(t))
    return rows.select(
        "profile", "name", "job_type", F.array_join("titles", "|").alias("titles"),
        *[F.col(c).cast("bigint").alias(c) for c in ("min_yoe", "max_yoe", "max_job_age_days")], "remote_ok",
        F.col("min_display_score").cast("bigint").alias("min_display_score"), F.col("weights.role_fit").alias("w_role"),
        F.col("sources_enabled.greenhouse").alias("greenhouse_on"), F.col("sources_enabled.hn").alias("hn_on"),
    )


def config_lines(t: Inputs) -> DataFrame:
    """One JSON configuration per customer, with optional parts left out here and there."""
    c = F.regexp_extract("profile", r"(\d+)$", 1).cast("bigint")
    odd = c % 2 == 1
    config = F.struct(
        F.col("profile").alias("profile_id"),
        F.struct("name", "bio", "job_type", "resume", "role_family").alias("profile"),
        F.struct(
            "titles", "desired_skills", "hard_no_keywords", "yoe",
            F.when(odd, F.struct("remote_ok", "preferred_locations")).alias("location"),
            F.struct("min_salary", "monthly_stipend", "intern_pay_preference").alias("compensation"),
            F.struct(
                F.when(odd, F.lit(1)).alias("min_yoe"), F.when(c % 3 != 0, F.lit(7)).alias("max_yoe"), "title_blocklist"
            ).alias("filters"),
        ).alias("preferences"),
        F.when(odd, F.struct(F.struct(F.lit(0.5).alias("role_fit")).alias("weights"))).alias("scoring"),
        F.struct(
            F.when(c % 5 == 1, F.struct(F.lit(False).alias("enabled"))).alias("greenhouse"),
            F.when(c % 4 == 0, F.struct(F.lit(True).alias("enabled"), string_array(["acme", "beta"]).alias("companies"))).alias("hn"),
            F.struct(string_array(["one", "two"]).alias("companies")).alias("lever"),
        ).alias("sources"),
    )
    return t.candidates.select(F.to_json(config).alias("value"))


def _configs(t: Inputs) -> DataFrame:
    return config_lines(t).select(F.from_json("value", P.CONFIG).alias("config"))


@query(
    "configured_companies",
    """SELECT profile, 'lever' AS source, unnest(['one', 'two']) AS slug, unnest([0, 1])::BIGINT AS position FROM v_candidates""",
)
def _(t: Inputs) -> DataFrame:
    rows = P.configured_companies(_configs(t))
    return rows.withColumn("position", F.col("position").cast("bigint"))


# ---- table changes -------------------------------------------------------------------------
# Half of the labelled documents are the stored table, all documents arrive, some repeatedly.


def _arrivals(t: Inputs) -> DataFrame:
    """Every document arrives once per label row of its id, plus once."""
    again = t.scores.select("profile", F.col("job_id").alias("id"), F.lit("again").alias("title"))
    first = t.postings.select("profile", "id", "title")
    return first.withColumn("arrival", F.lit(1)).unionByName(again.withColumn("arrival", F.lit(2)))


def _stored(t: Inputs) -> DataFrame:
    return t.scores.where("quality = 1").select("profile", F.col("job_id").alias("id"), F.lit("stored").alias("title"))


_STORED_SQL = "(SELECT profile, job_id AS id, 'stored' AS title FROM v_scores WHERE quality = 1)"


@query(
    "insert_or_ignore",
    f"""SELECT p.profile, p.id, p.title, 1 AS arrival FROM v_postings p WHERE NOT EXISTS (SELECT 1 FROM {_STORED_SQL} s WHERE s.profile = p.profile AND s.id = p.id)""",
)
def _(t: Inputs) -> DataFrame:
    return T.insert_or_ignore(_arrivals(t), _stored(t), ["profile", "id"])


@query(
    "insert_outcome",
    f"""SELECT p.profile, p.id, 1 + (l.job_id IS NOT NULL)::BIGINT AS arrived, (s.id IS NULL)::BIGINT AS inserted FROM v_postings p
LEFT JOIN v_scores l ON l.profile = p.profile AND l.job_id = p.id LEFT JOIN {_STORED_SQL} s ON s.profile = p.profile AND s.id = p.id""",
)
def _(t: Inputs) -> DataFrame:
    rows = T.insert_outcome(_arrivals(t), _stored(t), ["profile", "id"])
    return rows.withColumn("inserted", F.col("inserted").cast("bigint"))


@query(
    "upsert",
    """SELECT p.profile, p.id, coalesce(CASE WHEN s.job_id IS NOT NULL THEN 'again' END, p.title) AS title FROM v_postings p
LEFT JOIN v_scores s ON s.profile = p.profile AND s.job_id = p.id""",
)
def _(t: Inputs) -> DataFrame:
    new = t.scores.select("profile", F.col("job_id").alias("id"), F.lit("again").alias("title"))
    return T.upsert(new, t.postings.select("profile", "id", "title"), ["profile", "id"])


@query(
    "replace_group",
    """WITH n AS (SELECT profile, job_id, uid FROM v_chunks WHERE job_id IN (SELECT job_id FROM v_scores WHERE quality = 1) AND chunk_key = 'summary')
SELECT profile, job_id, concat('new_', uid) AS uid FROM n UNION ALL SELECT profile, job_id, uid FROM v_chunks c
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.profile = c.profile AND n.job_id = c.job_id)""",
)
def _(t: Inputs) -> DataFrame:
    good = t.scores.where("quality = 1").select("profile", "job_id")
    stored = t.chunks.select("profile", "job_id", "uid", "chunk_key")
    new = stored.where("chunk_key = 'summary'").join(good, ["profile", "job_id"], "left_semi")
    new = new.withColumn("uid", F.concat(F.lit("new_"), "uid")).drop("chunk_key")
    return T.replace_group(new, stored.drop("chunk_key"), ["profile", "job_id"])


@query("delete_where", "SELECT id FROM v_postings WHERE NOT (source = 'lever' AND coalesce(score_error, '') <> '')")
def _(t: Inputs) -> DataFrame:
    gone = (F.col("source") == "lever") & (F.col("score_error") != "")
    return T.delete_where(t.postings, gone).select("id")


@query("reset_attempts", "SELECT id, 0 AS score_attempts, CAST(NULL AS VARCHAR) AS score_error FROM v_postings")
def _(t: Inputs) -> DataFrame:
    return T.reset_attempts(t.postings).select("id", "score_attempts", "score_error")


_LAST_CHANGE = """last AS (SELECT profile, id, new_status FROM (SELECT *, row_number() OVER (PARTITION BY profile, id ORDER BY changed_at DESC, new_status DESC) AS rn
  FROM v_status_changes) x WHERE rn = 1),
log AS (SELECT p.profile, p.id, p.status AS previous_status, l.new_status FROM v_postings p JOIN last l ON l.profile = p.profile AND l.id = p.id
  WHERE p.status <> l.new_status)"""


@query("status_change_log", f"WITH {_LAST_CHANGE} SELECT * FROM log")
def _(t: Inputs) -> DataFrame:
    return T.status_change_log(t.postings, t.status_changes)


@query(
    "apply_status_changes",
    f"WITH {_LAST_CHANGE} SELECT p.id, coalesce(l.new_status, p.status) AS status FROM v_postings p LEFT JOIN log l ON l.profile = p.profile AND l.id = p.id",
)
def _(t: Inputs) -> DataFrame:
    return T.apply_status_changes(t.postings, T.status_change_log(t.postings, t.status_changes)).select("id", "status")


@query("undo_status_changes", "SELECT id, status FROM v_postings")
def _(t: Inputs) -> DataFrame:
    log = T.status_change_log(t.postings, t.status_changes)
    return T.undo_status_changes(T.apply_status_changes(t.postings, log), log).select("id", "status")


@query(
    "record_attempts",
    """WITH a AS (SELECT profile, id, count(*) AS tries, arg_max(error, tried_at) FILTER (error IS NOT NULL) AS error FROM v_attempts GROUP BY 1, 2)
SELECT p.id, p.score_attempts + coalesce(a.tries, 0) AS score_attempts, coalesce(substr(a.error, 1, 500), p.score_error) AS score_error
FROM v_postings p LEFT JOIN a ON a.profile = p.profile AND a.id = p.id""",
)
def _(t: Inputs) -> DataFrame:
    rows = T.record_attempts(t.postings, t.attempts)
    return rows.select("id", F.col("score_attempts").cast("bigint").alias("score_attempts"), "score_error")


# ---- batch twins of the streams ------------------------------------------------------------


@query(
    "funnel_by_hour",
    """SELECT epoch_us(date_trunc('hour', ts)) AS hour, CASE WHEN user_id % 3 = 0 THEN 'lever' ELSE 'ashby' END AS source, event_type AS stage,
  count(*) AS postings FROM events GROUP BY 1, 2, 3""",
)
def _(t: Inputs) -> DataFrame:
    rows = t.events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 3 == 0, "lever").otherwise("ashby").alias("source"), F.col("event_type").alias("stage"),
    )
    return funnel_by_hour(rows, late=None).withColumn("hour", F.unix_micros("hour"))


@query(
    "current_status",
    """SELECT profile, id, new_status AS status, epoch_us(changed_at) AS changed_at FROM (SELECT *, row_number() OVER (PARTITION BY profile, id
  ORDER BY changed_at DESC, change_id DESC) AS rn FROM v_status_changes) x WHERE rn = 1""",
)
def _(t: Inputs) -> DataFrame:
    return current_status(t.status_changes).withColumn("changed_at", F.unix_micros("changed_at"))


# ---- logs that may be repeated -------------------------------------------------------------


@query(
    "attempt_ledger",
    """SELECT profile, id, count(*) AS tries, substr(arg_max(error, tried_at) FILTER (error IS NOT NULL), 1, 500) AS error,
  epoch_us(max(tried_at) FILTER (error IS NOT NULL)) AS error_at FROM v_attempts GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    """Attempts in three batches, the second one twice, with a fold in between."""
    path = f"{shared_dir(t.spark)}/attempts-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("profile", "id", "tried_at"), F.lit(3))
    for batch in (0, 1, 1, 2):
        ledger.append_attempts(t.attempts.where(part == batch), path, batch)
    ledger.fold(t.spark, path)
    return ledger.totals(t.spark, path).withColumn("error_at", F.unix_micros("error_at"))


ORACLES["status_log"] = ORACLES["current_status"]


@query("status_log")
def _(t: Inputs) -> DataFrame:
    """Status changes in three batches, the last one twice, with all buckets folded in between."""
    path = f"{shared_dir(t.spark)}/statuses-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 2):
        statuses.append_changes(t.status_changes.where(F.col("change_id") % 3 == batch), path, batch, 8)
        if batch == 1:
            statuses.compact_statuses(t.spark, path, 2)
    return statuses.current_statuses(t.spark, path).withColumn("changed_at", F.unix_micros("changed_at"))
