"""Scoring postings: gate, responses, fit and coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions import scores as S
from siftwork.functions.strings import empty_strings, text_of
from siftwork.operators.calls import answered

KEY = ["profile", "id"]
SCORE_COLUMNS = [
    "profile", "job_id", "fit_score", *vocab.DIMENSIONS, "reasons", "flags", "skill_misses", "one_liner", "ats_score",
    "disqualified", "disqualify_reason",
]


def weight_columns(profiles: DataFrame) -> dict[str, Column]:
    """A profile's dimension weights, the defaults where it has none."""
    own = "weights" in profiles.columns
    return {
        d: F.coalesce(F.col(f"weights.{d}"), F.lit(w)) if own else F.lit(w)
        for d, w in vocab.DIMENSION_WEIGHTS.items()
    }


def _scoring_profile(profiles: DataFrame) -> DataFrame:
    lists = [F.coalesce(F.col(c), empty_strings()).alias(f"p_{c}") for c in ("titles", "desired_skills")]
    weights = F.struct(*[c.alias(d) for d, c in weight_columns(profiles).items()]).alias("weights")
    return profiles.select("profile", *lists, F.col("resume").alias("p_resume"), weights)


def gate(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Postings with their pre-score and, in ``gate_flag``, why they need no expensive score."""
    wanted = profiles.select(
        "profile",
        *[F.coalesce(F.col(c), empty_strings()).alias(f"p_{c}") for c in ("titles", "desired_skills")],
    )
    joined = postings.join(wanted, "profile")
    pre = S.keyword_prescore(F.col("title"), F.col("raw_text"), F.col("p_titles"), F.col("p_desired_skills"))
    flagged = joined.withColumn("prescore", pre).withColumn(
        "gate_flag", S.gate_flag(F.col("scrape_qualified"), F.col("scrape_filter_reason"), F.col("prescore"))
    )
    return flagged.drop("p_titles", "p_desired_skills")


def call_scorer(postings: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], list[str]]]) -> DataFrame:
    """(profile, id, raw) from a scoring function over Arrow batches of (profile, id, title, raw_text).

    Gate before this call: the optimizer cannot move a filter below it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for batch in batches:
            yield batch[["profile", "id"]].assign(raw=score(batch))

    return postings.select("profile", "id", "title", "raw_text").mapInPandas(run, "profile string, id string, raw string")


def cached_responses(
    postings: DataFrame, make_scorer: Callable[[], Callable[[list[str], list[str], list[str]], list[str]]], model_name: str, cache: str,
    batch_size: int = vocab.SCORER_BATCH,
) -> DataFrame:
    """(profile, id, raw) from a scoring function ``score(profiles, titles, raw_texts)``, called once per distinct input.

    Answers are kept in the table ``cache``: a posting that comes again, under any id, costs no call. Gate before it.
    """
    rows = postings.select("profile", "id", "title", "raw_text")
    return answered(rows, cache, model_name, ["profile", "title", "raw_text"], make_scorer, "string", batch_size, "raw").select("profile", "id", "raw")


def score_batch(postings: DataFrame, profiles: DataFrame, responses: DataFrame) -> DataFrame:
    """Score rows for a batch of postings, from responses given as (profile, id, raw).

    Gated postings are scored 0 with their flag. A posting whose response is no JSON object
    is saved with zeros, one without any response is left out (see ``failed_responses``).
    """
    gated = gate(postings, profiles)
    answered = gated.join(responses.select(*KEY, "raw"), KEY, "left")
    parsed = answered.withColumn("r", F.when(F.col("gate_flag").isNull(), S.parse_response(F.col("raw"))))
    kept = parsed.where(F.col("gate_flag").isNotNull() | F.col("raw").isNotNull())
    full = kept.join(_scoring_profile(profiles), "profile")
    ats, misses = S.ats_score(F.col("raw_text"), F.col("p_resume"), F.col("p_desired_skills"))
    graded = F.col("gate_flag").isNull()
    out = F.coalesce(F.col("r.disqualified"), F.lit(False))
    dims = {d: F.coalesce(F.col(f"r.{d}"), F.lit(0)) for d in vocab.DIMENSIONS}
    fit = S.fit_score(dims, {d: F.col(f"weights.{d}") for d in vocab.DIMENSIONS}, out)
    flags = (
        F.when(~graded, F.array("gate_flag"))
        .when(F.col("r").isNull(), F.array(F.lit("parse error")))
        .when(out, F.array(F.concat(F.lit("disqualified: "), F.col("r.disqualify_reason"))))
        .otherwise(F.coalesce(F.col("r.flags"), empty_strings()))
    )
    return full.select(
        "profile",
        F.col("id").alias("job_id"),
        F.when(graded, fit).otherwise(0).alias("fit_score"),
        *[dims[d].alias(d) for d in vocab.DIMENSIONS],
        F.when(out, empty_strings()).otherwise(F.coalesce(F.col("r.reasons"), empty_strings())).alias("reasons"),
        flags.alias("flags"),
        F.when(graded, misses).otherwise(empty_strings()).alias("skill_misses"),
        F.when(out, "").otherwise(text_of(F.col("r.one_liner"))).alias("one_liner"),
        F.when(graded, ats).otherwise(0).alias("ats_score"),
        out.alias("disqualified"),
        text_of(F.when(out, F.col("r.disqualify_reason"))).alias("disqualify_reason"),
    )


def best_first(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("fit_score"), "profile", "job_id")


def failed_responses(postings: DataFrame, profiles: DataFrame, responses: DataFrame) -> DataFrame:
    """Postings past the gate that got no response, for the error log."""
    due = gate(postings, profiles).where(F.col("gate_flag").isNull())
    return due.join(responses.select(*KEY), KEY, "left_anti").select(*KEY)


def validate_weights(profiles: DataFrame) -> DataFrame:
    """(profile, weight_sum, valid): the six weights must add up to 1 within 0.01."""
    total = sum(weight_columns(profiles).values(), F.lit(0.0))
    return profiles.select("profile", total.alias("weight_sum")).withColumn(
        "valid", F.col("weight_sum").between(0.99, 1.01)
    )


def checked_weights(profiles: DataFrame) -> DataFrame:
    """The same rows, but a wrong sum fails the job that reads them."""
    checked = validate_weights(profiles)
    message = F.concat(F.lit("weights must sum to 1.0, got "), F.col("weight_sum").cast("string"))
    return checked.withColumn(
        "valid", F.when(F.col("valid"), True).otherwise(F.raise_error(message).cast("boolean"))
    )
