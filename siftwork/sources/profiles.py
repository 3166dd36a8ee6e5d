"""Profile configurations as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.strings import empty_strings

_ENABLED = ",".join(f"{s}:struct<enabled:boolean,companies:array<string>>" for s in vocab.SOURCE_ENABLED_BY_DEFAULT)
_WEIGHTS = ",".join(f"{d}:double" for d in vocab.DIMENSIONS)

CONFIG = (
    "struct<profile_id:string,updated_at:string,"
    "profile:struct<name:string,bio:string,job_type:string,resume:string,role_family:string,titles:array<string>,"
    "industries:array<string>,education:array<string>,nice_to_haves:array<string>>,"
    "preferences:struct<titles:array<string>,desired_skills:array<string>,hard_no_keywords:array<string>,yoe:double,"
    "location:struct<remote_ok:boolean,preferred_locations:array<string>>,"
    "compensation:struct<min_salary:bigint,monthly_stipend:bigint,intern_pay_preference:string>,"
    "filters:struct<title_blocklist:array<string>,min_yoe:int,max_yoe:int,max_job_age_days:int,"
    "require_degree_filter:boolean>>,"
    f"llm:struct<provider:string>,scoring:struct<min_display_score:int,weights:struct<{_WEIGHTS}>>,"
    f"sources:struct<{_ENABLED}>>"
)


def profiles_from_config(configs: DataFrame, config: str = "config") -> DataFrame:
    """Rows with a parsed configuration struct to profile rows with defaults filled in."""

    def at(path: str) -> Column:
        return F.col(f"{config}.{path}")

    def default(path: str, value: object) -> Column:
        return F.coalesce(at(path), F.lit(value))

    def strings(path: str) -> Column:
        return F.coalesce(at(path), empty_strings())

    prefs, mine = "preferences", "profile"
    plain = {
        "name": at(f"{mine}.name"), "bio": at(f"{mine}.bio"), "job_type": default(f"{mine}.job_type", "fulltime"),
        "resume": at(f"{mine}.resume"), "role_family": at(f"{mine}.role_family"),
        "titles": F.when(F.size(strings(f"{mine}.titles")) > 0, at(f"{mine}.titles")).otherwise(strings(f"{prefs}.titles")),
        "desired_skills": strings(f"{prefs}.desired_skills"),
        "hard_no_keywords": strings(f"{prefs}.hard_no_keywords"),
        "remote_ok": default(f"{prefs}.location.remote_ok", True),
        "preferred_locations": strings(f"{prefs}.location.preferred_locations"),
        "min_yoe": default(f"{prefs}.filters.min_yoe", vocab.DEFAULT_MIN_YOE),
        "max_yoe": default(f"{prefs}.filters.max_yoe", vocab.DEFAULT_MAX_YOE),
        "max_job_age_days": default(f"{prefs}.filters.max_job_age_days", vocab.DEFAULT_MAX_JOB_AGE_DAYS),
        "require_degree_filter": default(f"{prefs}.filters.require_degree_filter", False),
        "title_blocklist": strings(f"{prefs}.filters.title_blocklist"),
        "yoe": default(f"{prefs}.yoe", 0.0),
        "min_salary": at(f"{prefs}.compensation.min_salary"),
        "monthly_stipend": at(f"{prefs}.compensation.monthly_stipend"),
        "intern_pay_preference": at(f"{prefs}.compensation.intern_pay_preference"),
        "industries": strings(f"{mine}.industries"),
        "education": strings(f"{mine}.education"),
        "nice_to_haves": strings(f"{mine}.nice_to_haves"),
        "min_display_score": default("scoring.min_display_score", vocab.DEFAULT_MIN_DISPLAY_SCORE),
        "provider": at("llm.provider"),
    }
    weights = F.struct(*[default(f"scoring.weights.{d}", w).alias(d) for d, w in vocab.DIMENSION_WEIGHTS.items()])
    enabled = F.struct(
        *[default(f"sources.{s}.enabled", on).alias(s) for s, on in vocab.SOURCE_ENABLED_BY_DEFAULT.items()]
    )
    return configs.select(
        at("profile_id").alias("profile"),
        *[c.alias(n) for n, c in plain.items()],
        weights.alias("weights"),
        enabled.alias("sources_enabled"),
        at("updated_at").try_cast("timestamp").alias("updated_at"),
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile rows from JSON-lines configurations."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return profiles_from_config(lines.select(F.from_json("value", CONFIG).alias("config")))


def configured_companies(configs: DataFrame, config: str = "config") -> DataFrame:
    """(profile, source, slug, position) of the companies a configuration lists per source."""
    lists = [
        F.struct(F.lit(s).alias("source"), F.coalesce(F.col(f"{config}.sources.{s}.companies"), empty_strings()).alias("slugs"))
        for s in ("greenhouse", "lever", "ashby", "workable")
    ]
    rows = configs.select(F.col(f"{config}.profile_id").alias("profile"), F.explode(F.array(*lists)).alias("x"))
    return rows.select("profile", "x.source", F.posexplode("x.slugs").alias("position", "slug"))


def enabled_only(raw: DataFrame, profiles: DataFrame) -> DataFrame:
    """Raw rows of the sources their profile has switched on."""
    names = {s: ("hackernews" if s == "hn" else s) for s in vocab.SOURCE_ENABLED_BY_DEFAULT}
    pairs = F.array(
        *[F.struct(F.lit(name).alias("source"), F.col(f"sources_enabled.{s}").alias("on")) for s, name in names.items()]
    )
    on = profiles.select("profile", F.explode(pairs).alias("x")).where("x.on").select("profile", "x.source")
    return raw.join(on, ["profile", "source"], "left_semi")
