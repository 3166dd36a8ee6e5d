"""The review queue: joins of postings and scores, filters, counts and shortlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions import text as X
from siftwork.functions.strings import empty_strings, filled, text_of
from siftwork.operators.textindex import add_to_text_index, search_text

POSTING_SUMMARY = [
    "profile", "id", "title", "company", "location", "url", "source", "score_attempts", "score_error", "status",
    "created_at", "scrape_qualified", "scrape_filter_reason",
]
KEY = ["profile", "id"]


def _scores_by_posting(scores: DataFrame) -> DataFrame:
    named = scores.withColumnRenamed("job_id", "id")
    return named.withColumnRenamed("location", "score_location")


# ---- joins ---------------------------------------------------------------------------------


def top_jobs(postings: DataFrame, scores: DataFrame, min_score: int = vocab.DEFAULT_MIN_DISPLAY_SCORE) -> DataFrame:
    """Scored postings at or above the threshold, best first."""
    good = _scores_by_posting(scores).where(F.col("fit_score") >= min_score)
    joined = postings.join(good, KEY, "inner").withColumn("ats_score", F.coalesce("ats_score", F.lit(0)))
    return joined.orderBy(F.desc("fit_score"), "profile", "id")


def review_rows(postings: DataFrame, scores: DataFrame, detail: bool = False) -> DataFrame:
    """Every posting with its score if it has one, plus the labels a reviewer sees.

    The list never reads ``raw_text``; ``detail=True`` adds it.
    """
    columns = POSTING_SUMMARY + (["raw_text"] if detail else [])
    joined = postings.select(*columns).join(_scores_by_posting(scores), KEY, "left")
    out, why = X.disqualified_signal(F.col("disqualified"), F.col("disqualify_reason"), F.col("flags"))
    rows = joined.select(
        *[c for c in joined.columns if c not in ("disqualified", "disqualify_reason", "scrape_qualified")],
        out.alias("disqualified"),
        why.alias("disqualify_reason"),
        F.coalesce("scrape_qualified", F.lit(True)).alias("scrape_qualified"),
    )
    return (
        rows.withColumn("score_state", X.score_state(F.col("fit_score"), F.col("score_attempts"), F.col("score_error")))
        .withColumn("source_label", X.source_label(F.col("source")))
        .withColumn("status_label", X.status_label(F.col("status")))
        .withColumn("one_liner", text_of(F.col("one_liner")))
        .withColumn("scrape_filter_reason", text_of(F.col("scrape_filter_reason")))
        .withColumn("queue", queue_of(F.col("disqualified"), F.col("scrape_qualified")))
    )


def review_queue(postings: DataFrame, scores: DataFrame) -> DataFrame:
    return review_rows(postings, scores).orderBy(
        F.coalesce("fit_score", F.lit(-1)).desc(), F.desc("created_at"), "profile", "id"
    )


def job_detail(postings: DataFrame, scores: DataFrame, job_id: str | Column) -> DataFrame:
    """One posting with everything known about it; the id reaches both scans."""
    return review_rows(postings, scores, detail=True).where(F.col("id") == job_id)


def index_rows(
    chunks: DataFrame, postings: DataFrame, scores: DataFrame, model_name: str, job_ids: DataFrame | None = None
) -> DataFrame:
    """Embedded chunks of one model with posting and score fields, for a vector index.

    ``job_ids`` is a DataFrame of (profile, job_id); an empty one selects nothing.
    """
    wanted = chunks.where(F.col("model_name") == model_name)
    if job_ids is not None:
        wanted = wanted.join(job_ids.select("profile", "job_id"), ["profile", "job_id"], "left_semi")
    meta = postings.select("profile", F.col("id").alias("job_id"), "title", "company", "source", "url", "status")
    graded = scores.select("profile", "job_id", "scored_at", "fit_score", "ats_score")
    return wanted.join(meta, ["profile", "job_id"], "inner").join(graded, ["profile", "job_id"], "left")


def pending_embeddings(
    postings: DataFrame, scores: DataFrame, chunks: DataFrame, model_name: str,
    force: bool = False, limit: int | None = None,
) -> DataFrame:
    """Qualified, scored postings that have no chunk of this model yet; with a limit, the newest so many of each profile."""
    scored = scores.select("profile", F.col("job_id").alias("id"))
    due = postings.where(F.col("scrape_qualified")).join(scored, KEY, "left_semi")
    if not force:
        done = chunks.where(F.col("model_name") == model_name).select("profile", F.col("job_id").alias("id"))
        due = due.join(done, KEY, "left_anti")
    if limit is not None:
        due = _per_profile(due, [F.desc("created_at"), "id"], limit)
    return due


def unscored(postings: DataFrame, scores: DataFrame) -> DataFrame:
    return postings.join(scores.select("profile", F.col("job_id").alias("id")), KEY, "left_anti")


def eligible_for_scoring(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Unscored, qualified and not given up yet; filters run before the anti-join."""
    open_ = postings.where((F.col("score_attempts") < vocab.MAX_SCORE_ATTEMPTS) & F.col("scrape_qualified"))
    return unscored(open_, scores)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "profile", "id")


# ---- filters -------------------------------------------------------------------------------


def queue_of(disqualified: Column, qualified: Column) -> Column:
    """Which of the lists a posting belongs to; a disqualified one may also be rejected."""
    return (
        F.when(disqualified, "disqualified").when(~qualified, "scrape_rejected").otherwise("review")
    )


def partition_queue(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(review, disqualified, scrape rejected)."""
    bad, good = F.col("disqualified"), F.col("scrape_qualified")
    return rows.where(~bad & good), rows.where(bad), rows.where(~good)


def review_filter(
    rows: DataFrame, sources: Sequence[str] = (), statuses: Sequence[str] = (), states: Sequence[str] = (),
    min_fit: int = 0, search: str = "", full_text: bool = False,
) -> DataFrame:
    """Filters of the review page; an empty list does not filter, the search is literal text."""
    if sources:
        rows = rows.where(F.col("source_label").isin(list(sources)))
    if statuses:
        rows = rows.where(F.col("status_label").isin(list(statuses)))
    if states:
        rows = rows.where(F.col("score_state").isin(list(states)))
    if min_fit > 0:
        rows = rows.where(F.col("fit_score") >= min_fit)
    wanted = search.lower().strip()
    if wanted:
        fields = ["title", "company", "location", "source_label", "one_liner"]
        shown = F.lower(F.concat_ws(" ", *[text_of(F.col(c)) for c in fields]))
        hit = F.contains(shown, F.lit(wanted))
        if full_text:
            hit = hit | F.contains(F.lower(text_of(F.col("raw_text"))), F.lit(wanted))
        rows = rows.where(hit)
    return rows


def _with_shown(rows: DataFrame) -> DataFrame:
    fields = ["title", "company", "location", "source_label", "one_liner"]
    return rows.withColumn("_shown", F.concat_ws(" ", *[text_of(F.col(c)) for c in fields]))


def index_review_rows(rows: DataFrame, path: str, part: int = 0) -> None:
    """Adds review rows with their ``raw_text`` to the full-text index at ``path``."""
    add_to_text_index(_with_shown(rows), path, ["_shown", "raw_text"], KEY, part)


def review_search(rows: DataFrame, path: str, search: str) -> DataFrame:
    """The rows that ``review_filter`` with ``full_text`` keeps for a search, through the index at ``path``."""
    return search_text(_with_shown(rows), path, search, ["_shown", "raw_text"], KEY).drop("_shown")


def min_display(scores: DataFrame, minimum: int | Column = vocab.DEFAULT_MIN_DISPLAY_SCORE) -> DataFrame:
    return scores.where(F.col("fit_score") >= minimum)


def queue_pool(rows: DataFrame, show_rejected: bool) -> DataFrame:
    """The queue, joined by the scrape-rejected postings when asked for; one pass over the rows."""
    clean = ~F.col("disqualified") & F.col("scrape_qualified")
    return rows.where(clean | ~F.col("scrape_qualified")) if show_rejected else rows.where(clean)


def review_projection(rows: DataFrame, optional: Sequence[str] = vocab.REVIEW_OPTIONAL_COLUMNS) -> DataFrame:
    """The table a reviewer sees: five fixed columns, then the chosen ones in their fixed order."""
    columns = {
        "Title": F.col("title"),
        "Company": F.col("company"),
        "Job status": F.col("status_label"),
        "Score state": F.col("score_state"),
        "Fit": F.col("fit_score"),
        "Location": F.coalesce(filled(F.col("location")), F.lit("Location not listed")),
        "Source": F.col("source_label"),
        "ATS": F.col("ats_score"),
        "Summary": F.col("one_liner"),
        "Posting": text_of(F.col("url")),
        "Filter reason": F.col("scrape_filter_reason"),
    }
    shown = ["Title", "Company", "Job status", "Score state", "Fit"]
    shown += [c for c in vocab.REVIEW_OPTIONAL_COLUMNS if c in set(optional)]
    return rows.select("id", *[columns[c].alias(c) for c in shown])


# ---- counts --------------------------------------------------------------------------------


def count_jobs(postings: DataFrame, scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per profile: postings, scores, and distinct embedded postings."""

    def counted(df: DataFrame, name: str, expr: Column) -> DataFrame:
        return df.groupBy("profile").agg(expr.alias(name))

    total = counted(postings, "total", F.count("*"))
    scored = counted(scores, "scored", F.count("*"))
    embedded = counted(chunks, "embedded", F.count_distinct("job_id"))
    joined = total.join(scored, "profile", "full").join(embedded, "profile", "full")
    return joined.na.fill(0, ["total", "scored", "embedded"])


def queue_metrics(rows: DataFrame) -> DataFrame:
    """Per profile: counts by state and status and the average fit of the postings in review."""
    kept = ~F.col("disqualified") & F.col("scrape_qualified")

    def n(cond: Column) -> Column:
        return F.count_if(kept & cond)

    state, status, fit = F.col("score_state"), F.col("status"), F.col("fit_score")
    mean = F.avg(F.when(kept & (fit > 0), fit))
    return rows.groupBy("profile").agg(
        F.count_if(kept).alias("total"),
        n(state == "Scored").alias("scored"),
        n(state == "Pending").alias("pending"),
        n(state == "Failed").alias("failed"),
        n(state == "Needs retry").alias("needs_retry"),
        n(status == "applied").alias("applied"),
        n(status == "skipped").alias("skipped"),
        F.coalesce(F.rint(mean * 10.0) / 10.0, F.lit(0.0)).alias("avg_fit"),
        F.count_if(F.col("disqualified")).alias("disqualified_count"),
        F.count_if(~F.col("scrape_qualified")).alias("scrape_rejected_count"),
    ).withColumn("db_total", F.col("total") + F.col("disqualified_count") + F.col("scrape_rejected_count"))


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("profile", "source_label").agg(F.count("*").alias("postings"))


def disqualified_by_reason(rows: DataFrame) -> DataFrame:
    reason = F.coalesce(filled(F.col("disqualify_reason")), F.lit("unknown"))
    counts = rows.where("disqualified").groupBy("profile", reason.alias("reason")).agg(F.count("*").alias("postings"))
    return counts.orderBy("profile", F.desc("postings"), "reason")


def rejected_by_reason(rows: DataFrame) -> DataFrame:
    reason = F.coalesce(filled(F.col("scrape_filter_reason")), F.lit("unknown"))
    prefix = F.get(F.split(reason, ":"), F.lit(0))
    counts = rows.where(~F.col("scrape_qualified")).groupBy("profile", prefix.alias("reason"))
    return counts.agg(F.count("*").alias("postings")).orderBy("profile", F.desc("postings"), "reason")


def run_score_stats(scores: DataFrame) -> DataFrame:
    """Per profile: postings with a positive fit and their average scores."""
    positive = F.col("fit_score") > 0
    return scores.groupBy("profile").agg(
        F.count_if(positive).alias("jobs_scored"),
        F.coalesce(F.avg(F.when(positive, F.col("fit_score"))), F.lit(0.0)).alias("avg_fit_score"),
        F.coalesce(F.avg(F.when(positive, F.col("ats_score"))), F.lit(0.0)).alias("avg_ats_score"),
    )


def attention(metrics: DataFrame) -> DataFrame:
    """Share applied, in whole percent, and the postings that need a look."""
    rate = F.rint(F.col("applied") * 100.0 / F.nullif(F.col("total"), F.lit(0))).cast("bigint")
    return metrics.select(
        "profile",
        F.concat(F.coalesce(rate, F.lit(0)).cast("string"), F.lit("%")).alias("applied_rate"),
        (F.col("needs_retry") + F.col("failed")).alias("needs_attention"),
    )


def profile_overview(profiles: DataFrame, counts: DataFrame) -> DataFrame:
    """Profiles with their counts, latest changed configuration first."""
    named = F.initcap(F.replace("profile", F.lit("_"), F.lit(" ")))
    rows = profiles.select(
        "profile",
        F.coalesce("name", named).alias("name"),
        F.coalesce("job_type", F.lit("fulltime")).alias("job_type"),
        F.coalesce("provider", F.lit("unknown")).alias("provider"),
        "updated_at",
    )
    joined = rows.join(counts, "profile", "left").na.fill(0, ["total", "scored", "embedded"])
    return joined.orderBy(F.desc("updated_at"), "profile")


def filter_options(rows: DataFrame) -> DataFrame:
    """The distinct values of each filter, sorted: (profile, filter, option)."""
    options = rows.unpivot(
        ["profile"], ["source_label", "status_label", "score_state"], "filter", "option"
    )
    return options.distinct().orderBy("profile", "filter", "option")


def dimension_breakdown(scores: DataFrame) -> DataFrame:
    """One row per posting and scored dimension, highest first within a posting."""
    long = scores.unpivot(["profile", "job_id"], vocab.DIMENSIONS, "dimension", "score").where("score IS NOT NULL")
    named = long.withColumn("dimension", X.title_case(F.replace("dimension", F.lit("_"), F.lit(" "))))
    return named.orderBy("profile", "job_id", F.desc("score"), "dimension")


# ---- shortlists ----------------------------------------------------------------------------


def _per_profile(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy("profile").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_matches(rows: DataFrame, n: int = 6) -> DataFrame:
    """The first scored postings of each profile's queue."""
    scored = rows.where(F.col("fit_score").isNotNull())
    return _per_profile(scored, [F.desc("fit_score"), F.desc("created_at"), "id"], n)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The last started runs of each profile."""
    return _per_profile(runs, [F.desc("started_at"), "run_id"], limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last started run of each profile, reduced before the shuffle."""
    others = [c for c in runs.columns if c != "profile"]
    newest = F.max_by(F.struct(*others), F.struct("started_at", "run_id"))
    return runs.groupBy("profile").agg(newest.alias("r")).select("profile", "r.*")


def parse_errors(errors: Column) -> Column:
    """A run's error list from its JSON text."""
    return F.coalesce(F.from_json(errors, "array<string>"), empty_strings())

