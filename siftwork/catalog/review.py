"""Review queue, counts, shortlists, runs, companies and usage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.catalog.core import ORACLES, Inputs, query, quoted
from siftwork.operators import companies as C
from siftwork.operators import review as R
from siftwork.operators.scoring import best_first
from siftwork.operators.usage import rolling_usage
from siftwork.session import shared_dir

_JOIN = "v_postings p JOIN v_scores s ON s.profile = p.profile AND s.job_id = p.id"
_LEFT = "v_postings p LEFT JOIN v_scores s ON s.profile = p.profile AND s.job_id = p.id"
_SOURCE_LABEL = f"CASE p.source {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in vocab.SOURCE_LABELS.items())} END"

# Review rows once, for every query that starts from them.
_ROWS = f"""r AS (
SELECT p.profile, p.id, p.title, p.company, p.location, p.url, p.source, p.status, p.created_at, p.raw_text, s.fit_score, s.ats_score,
  coalesce(s.one_liner, '') AS one_liner, p.scrape_qualified, p.scrape_filter_reason,
  coalesce(s.disqualified, FALSE) OR (coalesce(s.disqualify_reason, '') = '' AND flag IS NOT NULL) AS disqualified,
  CASE WHEN NOT coalesce(s.disqualified, FALSE) AND coalesce(s.disqualify_reason, '') = '' AND flag IS NOT NULL THEN trim(substr(flag, 14))
    ELSE coalesce(s.disqualify_reason, '') END AS disqualify_reason,
  CASE WHEN s.fit_score IS NOT NULL THEN 'Scored' WHEN p.score_attempts >= 3 THEN 'Failed'
    WHEN coalesce(p.score_error, '') <> '' THEN 'Needs retry' ELSE 'Pending' END AS score_state,
  {_SOURCE_LABEL} AS source_label, concat(upper(p.status[1]), substr(p.status, 2)) AS status_label
FROM v_postings p LEFT JOIN (SELECT *, list_filter(flags, lambda f: starts_with(f, 'disqualified:'))[1] AS flag FROM v_scores) s
  ON s.profile = p.profile AND s.job_id = p.id)"""


def _rows(t: Inputs, detail: bool = False) -> DataFrame:
    return R.review_rows(t.postings, t.scores, detail)


# ---- joins ---------------------------------------------------------------------------------


@query(
    "top_jobs",
    f"SELECT p.profile, p.id, p.title, s.fit_score, coalesce(s.ats_score, 0) AS ats_score, s.role_fit FROM {_JOIN} WHERE s.fit_score >= 60",
)
def _(t: Inputs) -> DataFrame:
    return R.top_jobs(t.postings, t.scores, 60).select("profile", "id", "title", "fit_score", "ats_score", "role_fit")


@query(
    "review_queue",
    f"""WITH {_ROWS}, q AS (SELECT *, row_number() OVER (ORDER BY coalesce(fit_score, -1) DESC, created_at DESC, profile, id) AS pos FROM r)
SELECT id, profile, title, score_state, source_label, status_label, fit_score, ats_score, one_liner, disqualified, disqualify_reason,
  CASE WHEN disqualified THEN 'disqualified' WHEN NOT scrape_qualified THEN 'scrape_rejected' ELSE 'review' END AS queue FROM q""",
)
def _(t: Inputs) -> DataFrame:
    return R.review_queue(t.postings, t.scores).select(
        "id", "profile", "title", "score_state", "source_label", "status_label", "fit_score", "ats_score", "one_liner",
        "disqualified", "disqualify_reason", "queue",
    )


@query("job_detail", f"WITH {_ROWS} SELECT id, raw_text, score_state, fit_score FROM r WHERE id = 'doc_17'")
def _(t: Inputs) -> DataFrame:
    return R.job_detail(t.postings, t.scores, "doc_17").select("id", "raw_text", "score_state", "fit_score")


@query(
    "index_rows",
    """
SELECT c.uid, c.profile, c.job_id, c.chunk_key, p.title AS posting_title, p.status, s.fit_score, s.ats_score
FROM v_chunks c JOIN v_postings p ON p.profile = c.profile AND p.id = c.job_id
LEFT JOIN v_scores s ON s.profile = c.profile AND s.job_id = c.job_id WHERE c.model_name = 'hash-64/v1'
""",
)
def _(t: Inputs) -> DataFrame:
    chunks = t.chunks.drop("title", "company", "source", "url")
    rows = R.index_rows(chunks, t.postings, t.scores, "hash-64/v1")
    return rows.select(
        "uid", "profile", "job_id", "chunk_key", F.col("title").alias("posting_title"), "status", "fit_score", "ats_score"
    )


@query(
    "index_rows_of_ids",
    """
SELECT c.uid, c.job_id, p.status FROM v_chunks c JOIN v_postings p ON p.profile = c.profile AND p.id = c.job_id
WHERE c.job_id IN (SELECT job_id FROM v_scores WHERE fit_score > 50)
""",
)
def _(t: Inputs) -> DataFrame:
    ids = t.scores.where("fit_score > 50").select("profile", "job_id")
    chunks = t.chunks.drop("title", "company", "source", "url")
    return R.index_rows(chunks, t.postings, t.scores, "hash-64/v1", ids).select("uid", "job_id", "status")


@query(
    "pending_embeddings",
    """
SELECT p.profile, p.id FROM v_postings p JOIN v_scores s ON s.profile = p.profile AND s.job_id = p.id
WHERE p.scrape_qualified AND NOT EXISTS (SELECT 1 FROM v_chunks c WHERE c.profile = p.profile AND c.job_id = p.id AND c.model_name = 'hash-64/v1')
""",
)
def _(t: Inputs) -> DataFrame:
    return R.pending_embeddings(t.postings, t.scores, t.chunks, "hash-64/v1").select("profile", "id")


@query(
    "pending_embeddings_forced",
    f"""SELECT profile, id FROM (SELECT p.profile, p.id, row_number() OVER (PARTITION BY p.profile ORDER BY p.created_at DESC, p.id) AS rn
  FROM {_JOIN} WHERE p.scrape_qualified) x WHERE rn <= 200""",
)
def _(t: Inputs) -> DataFrame:
    return R.pending_embeddings(t.postings, t.scores, t.chunks, "hash-64/v1", force=True, limit=200).select("profile", "id")


@query("unscored", f"SELECT p.id FROM {_LEFT} WHERE s.job_id IS NULL")
def _(t: Inputs) -> DataFrame:
    return R.unscored(t.postings, t.scores).select("id")


@query(
    "eligible_for_scoring",
    f"SELECT p.profile, p.id FROM {_LEFT} WHERE s.job_id IS NULL AND p.score_attempts < 3 AND p.scrape_qualified",
)
def _(t: Inputs) -> DataFrame:
    return R.newest_first(R.eligible_for_scoring(t.postings, t.scores)).select("profile", "id")


# ---- filters -------------------------------------------------------------------------------


@query(
    "review_filter",
    f"""WITH {_ROWS} SELECT id FROM r WHERE source_label IN ('Greenhouse', 'Lever', 'Ashby') AND status_label IN ('New', 'Applied')
  AND score_state IN ('Scored') AND fit_score >= 20 AND contains(lower(concat_ws(' ', title, company, location, source_label, one_liner)), 'engineer')""",
)
def _(t: Inputs) -> DataFrame:
    rows = R.review_filter(
        _rows(t), ["Greenhouse", "Lever", "Ashby"], ["New", "Applied"], ["Scored"], 20, " Engineer "
    )
    return rows.select("id")


@query(
    "review_filter_full_text",
    f"""WITH {_ROWS} SELECT id FROM r WHERE contains(lower(concat_ws(' ', title, company, location, source_label, one_liner)), 'license')
  OR contains(lower(raw_text), 'license')""",
)
def _(t: Inputs) -> DataFrame:
    return R.review_filter(_rows(t, detail=True), search="License", full_text=True).select("id")


ORACLES["review_filter_by_index"] = ORACLES["review_filter_full_text"]


@query("review_filter_by_index")
def _(t: Inputs) -> DataFrame:
    """The same search through a trigram index of the shown fields and the text."""
    rows, path = _rows(t, detail=True), f"{shared_dir(t.spark)}/text-{uuid.uuid4().hex}"
    R.index_review_rows(rows, path)
    return R.review_search(rows, path, "License").select("id")


@query(
    "min_display",
    "SELECT job_id, fit_score FROM v_scores s JOIN v_tenants t ON t.profile = s.profile WHERE fit_score >= min_display_score",
)
def _(t: Inputs) -> DataFrame:
    joined = t.scores.join(t.tenants.select("profile", "min_display_score"), "profile")
    return R.min_display(joined, F.col("min_display_score")).select("job_id", "fit_score")


@query(
    "partition_queue",
    f"""WITH {_ROWS} SELECT profile, 'review' AS part, count(*) AS postings FROM r WHERE NOT disqualified AND scrape_qualified GROUP BY 1
UNION ALL SELECT profile, 'disqualified', count(*) FROM r WHERE disqualified GROUP BY 1
UNION ALL SELECT profile, 'scrape_rejected', count(*) FROM r WHERE NOT scrape_qualified GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    rows = _rows(t)
    disqualified, qualified = F.col("disqualified"), F.col("scrape_qualified")
    # One pass: a posting is listed under every part it belongs to.
    parts = F.array_compact(
        F.array(
            F.when(~disqualified & qualified, F.lit("review")), F.when(disqualified, F.lit("disqualified")),
            F.when(~qualified, F.lit("scrape_rejected")),
        )
    )
    return rows.select("profile", F.explode(parts).alias("part")).groupBy("profile", "part").agg(
        F.count("*").alias("postings")
    )


@query(
    "queue_with_rejected",
    f"WITH {_ROWS} SELECT id FROM r WHERE (NOT disqualified AND scrape_qualified) OR NOT scrape_qualified",
)
def _(t: Inputs) -> DataFrame:
    return R.queue_pool(_rows(t), show_rejected=True).select("id")


@query(
    "review_projection",
    f"""WITH {_ROWS} SELECT id, title AS "Title", company AS "Company", status_label AS "Job status", score_state AS "Score state",
  fit_score AS "Fit", location AS "Location", source_label AS "Source", ats_score AS "ATS", one_liner AS "Summary", url AS "Posting",
  scrape_filter_reason AS "Filter reason" FROM r""",
)
def _(t: Inputs) -> DataFrame:
    return R.review_projection(_rows(t))


# ---- counts --------------------------------------------------------------------------------


@query(
    "count_jobs",
    """
SELECT p.profile, p.total, coalesce(s.scored, 0) AS scored, coalesce(c.embedded, 0) AS embedded
FROM (SELECT profile, count(*) AS total FROM v_postings GROUP BY 1) p
LEFT JOIN (SELECT profile, count(*) AS scored FROM v_scores GROUP BY 1) s ON s.profile = p.profile
LEFT JOIN (SELECT profile, count(DISTINCT job_id) AS embedded FROM v_chunks GROUP BY 1) c ON c.profile = p.profile
""",
)
def _(t: Inputs) -> DataFrame:
    return R.count_jobs(t.postings, t.scores, t.chunks)


_METRICS = f"""{_ROWS}, m AS (SELECT profile, count(*) FILTER (k) AS total, count(*) FILTER (k AND score_state = 'Scored') AS scored,
  count(*) FILTER (k AND score_state = 'Pending') AS pending, count(*) FILTER (k AND score_state = 'Failed') AS failed,
  count(*) FILTER (k AND score_state = 'Needs retry') AS needs_retry, count(*) FILTER (k AND status = 'applied') AS applied,
  count(*) FILTER (k AND status = 'skipped') AS skipped,
  coalesce(round_even(avg(fit_score) FILTER (k AND fit_score > 0) * 10e0, 0) / 10e0, 0e0) AS avg_fit,
  count(*) FILTER (disqualified) AS disqualified_count, count(*) FILTER (NOT scrape_qualified) AS scrape_rejected_count
FROM (SELECT *, NOT disqualified AND scrape_qualified AS k FROM r) x GROUP BY profile)"""


@query(
    "queue_metrics",
    f"WITH {_METRICS} SELECT *, total + disqualified_count + scrape_rejected_count AS db_total FROM m",
)
def _(t: Inputs) -> DataFrame:
    return R.queue_metrics(_rows(t))


@query(
    "attention",
    f"""WITH {_METRICS} SELECT profile, concat(CAST(round_even(applied * 100e0 / total, 0) AS BIGINT), '%') AS applied_rate,
  needs_retry + failed AS needs_attention FROM m""",
)
def _(t: Inputs) -> DataFrame:
    return R.attention(R.queue_metrics(_rows(t)))


@query(
    "source_counts",
    f"WITH {_ROWS} SELECT profile, source_label, count(*) AS postings FROM r WHERE NOT disqualified AND scrape_qualified GROUP BY 1, 2",
)
def _(t: Inputs) -> DataFrame:
    return R.source_counts(R.partition_queue(_rows(t))[0])


@query(
    "disqualified_by_reason",
    f"WITH {_ROWS} SELECT profile, coalesce(nullif(disqualify_reason, ''), 'unknown') AS reason, count(*) AS postings FROM r WHERE disqualified GROUP BY 1, 2",
)
def _(t: Inputs) -> DataFrame:
    return R.disqualified_by_reason(_rows(t))


@query(
    "rejected_by_reason",
    f"""WITH {_ROWS} SELECT profile, split_part(coalesce(nullif(scrape_filter_reason, ''), 'unknown'), ':', 1) AS reason, count(*) AS postings
FROM r WHERE NOT scrape_qualified GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return R.rejected_by_reason(_rows(t))


@query(
    "run_score_stats",
    """
SELECT profile, count(*) FILTER (fit_score > 0) AS jobs_scored, round(coalesce(avg(fit_score) FILTER (fit_score > 0), 0), 6) AS avg_fit_score,
  round(coalesce(avg(ats_score) FILTER (fit_score > 0), 0), 6) AS avg_ats_score FROM v_scores GROUP BY profile
""",
)
def _(t: Inputs) -> DataFrame:
    stats = R.run_score_stats(t.scores)
    return stats.select("profile", "jobs_scored", *[F.round(c, 6).alias(c) for c in ("avg_fit_score", "avg_ats_score")])


@query(
    "profile_overview",
    """
SELECT t.profile, t.name, t.job_type, coalesce(t.provider, 'unknown') AS provider, coalesce(c.total, 0) AS total
FROM v_tenants t LEFT JOIN (SELECT profile, count(*) AS total FROM v_postings GROUP BY 1) c ON c.profile = t.profile
""",
)
def _(t: Inputs) -> DataFrame:
    counts = R.count_jobs(t.postings, t.scores, t.chunks)
    return R.profile_overview(t.tenants, counts).select("profile", "name", "job_type", "provider", "total")


@query(
    "filter_options",
    f"""WITH {_ROWS} SELECT DISTINCT profile, 'source_label' AS filter, source_label AS option FROM r
UNION ALL SELECT DISTINCT profile, 'status_label', status_label FROM r UNION ALL SELECT DISTINCT profile, 'score_state', score_state FROM r""",
)
def _(t: Inputs) -> DataFrame:
    return R.filter_options(_rows(t))


@query(
    "dimension_breakdown",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT profile, job_id, {quoted(d.replace('_', ' ').title())} AS dimension, CAST({d} AS BIGINT) AS score FROM v_scores" for d in vocab.DIMENSIONS
    ) + ") x WHERE score IS NOT NULL",
)
def _(t: Inputs) -> DataFrame:
    return R.dimension_breakdown(t.scores).withColumn("score", F.col("score").cast("bigint"))


# ---- shortlists and runs -------------------------------------------------------------------


@query(
    "top_matches",
    f"""WITH {_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY fit_score DESC, created_at DESC, id) AS rn
  FROM r WHERE fit_score IS NOT NULL AND NOT disqualified AND scrape_qualified) SELECT profile, id, fit_score FROM k WHERE rn <= 6""",
)
def _(t: Inputs) -> DataFrame:
    return R.top_matches(R.partition_queue(_rows(t))[0]).select("profile", "id", "fit_score")


@query(
    "recent_runs",
    "SELECT run_id, profile FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY started_at DESC, run_id) AS rn FROM v_runs) x WHERE rn <= 20",
)
def _(t: Inputs) -> DataFrame:
    return R.recent_runs(t.runs).select("run_id", "profile")


@query(
    "latest_run",
    """SELECT profile, run_id, status, source FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY started_at DESC, run_id DESC) AS rn
  FROM v_runs) x WHERE rn = 1""",
)
def _(t: Inputs) -> DataFrame:
    return R.latest_run(t.runs).select("profile", "run_id", "status", "source")


@query("best_first", "SELECT profile, job_id, fit_score FROM v_scores")
def _(t: Inputs) -> DataFrame:
    return best_first(t.scores).select("profile", "job_id", "fit_score")


@query(
    "rolling_usage",
    """
SELECT provider, request_id, count(*) OVER m AS requests_60s, CAST(sum(tokens) OVER m AS BIGINT) AS tokens_60s, count(*) OVER d AS requests_24h,
  count(*) OVER m >= 2 AS rpm_reached, sum(tokens) OVER m >= 9000 AS tpm_reached, count(*) OVER d >= 150 AS rpd_reached
FROM v_request_log
WINDOW m AS (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW),
  d AS (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW)
""",
)
def _(t: Inputs) -> DataFrame:
    return rolling_usage(t.request_log, 2, 9000, 150).drop("ts", "tokens")


# ---- companies -----------------------------------------------------------------------------

_CACHED = "(SELECT profile, source, slug, max(discovered_at) AS discovered_at FROM v_companies GROUP BY 1, 2, 3)"


def _cached(t: Inputs) -> DataFrame:
    return t.companies.groupBy(*C.KEY).agg(F.max("discovered_at").alias("discovered_at"))


@query("newest_companies", f"SELECT profile, source, slug FROM {_CACHED} c")
def _(t: Inputs) -> DataFrame:
    return C.newest_companies(_cached(t)).select(*C.KEY)


@query(
    "merged_companies",
    f"""SELECT profile, source, slug, 0 AS part, position FROM v_listed_companies
UNION ALL SELECT profile, source, slug, 1, -epoch_us(discovered_at) FROM {_CACHED} c
WHERE NOT EXISTS (SELECT 1 FROM v_listed_companies l WHERE l.profile = c.profile AND l.source = c.source AND l.slug = c.slug)""",
)
def _(t: Inputs) -> DataFrame:
    return C.merged_companies(t.listed_companies, _cached(t))


@query(
    "with_new_companies",
    """SELECT profile, source, slug FROM v_listed_companies UNION ALL SELECT profile, source, slug FROM v_companies c
WHERE NOT EXISTS (SELECT 1 FROM v_listed_companies l WHERE l.profile = c.profile AND l.source = c.source AND l.slug = c.slug)""",
)
def _(t: Inputs) -> DataFrame:
    return C.with_new_companies(t.companies, t.listed_companies)


@query(
    "stale_ids",
    "SELECT DISTINCT profile, job_id FROM v_chunks EXCEPT SELECT profile, job_id FROM v_scores",
)
def _(t: Inputs) -> DataFrame:
    return C.stale_ids(t.chunks, t.scores, ["profile", "job_id"])


@query(
    "union_of_sources",
    "SELECT id, source FROM v_postings UNION ALL SELECT job_id, source FROM v_chunks",
)
def _(t: Inputs) -> DataFrame:
    from siftwork.sources.payloads import union_postings

    boards = [t.postings.where(F.col("source") == s).select("id", "source") for s in vocab.SOURCES]
    return union_postings(boards + [t.chunks.select(F.col("job_id").alias("id"), "source")])
