"""Profiles to what their owner looks for: family, seniority, skills, query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.strings import (
    contains_any, count_of, dedupe_exact, dedupe_ignoring_case, empty_strings, filled, is_one_of, let, non_empty, strip,
    term_table,
    text_of,
)


def _array(name: str) -> Column:
    return F.coalesce(F.col(name), empty_strings())


def role_family() -> Column:
    """The stated family if it is a known one, else the one with most title and skill signals.

    A title signal counts two, a skill signal one; ties go to the earlier family.
    """
    stated = strip(F.lower(text_of(F.col("role_family"))))
    combined = F.concat_ws(
        " ",
        F.lower(F.array_join(_array("titles"), " ")),
        F.lower(F.array_join(_array("desired_skills"), " ")),
        F.lower(text_of(F.col("bio"))),
        F.substring(F.lower(text_of(F.col("resume"))), 1, 600),
    )

    def votes(text: Column) -> Column:
        return F.transform(
            term_table(vocab.FAMILY_TITLES, vocab.FAMILY_SKILLS),
            lambda row: F.struct(
                (count_of(text, row["terms"]) * 2 + count_of(text, row["extra"])).alias("votes"),
                row["rank"].alias("rank"),
                row["key"].alias("family"),
            ),
        )

    internship = F.lower(text_of(F.col("job_type"))) == "internship"

    def decided(best: Column) -> Column:
        return (
            F.when(best["votes"] == 0, F.when(internship, "internship").otherwise("general"))
            .when((F.col("job_type") == "internship") & (best["votes"] <= 2), "internship")
            .otherwise(best["family"])
        )

    inferred = let(let(combined, lambda text: F.array_max(votes(text))), decided)
    return F.when(is_one_of(stated, vocab.ROLE_FAMILIES), stated).otherwise(inferred)


def seniority() -> Column:
    yoe = F.coalesce(F.col("yoe"), F.lit(0.0))
    return (
        F.when(F.lower(text_of(F.col("job_type"))) == "internship", "intern")
        .when(yoe <= 2, "entry").when(yoe <= 5, "mid").when(yoe <= 8, "senior").otherwise("staff")
    )


def split_skills_tools(skills: Column, whole_word: bool = False) -> tuple[Column, Column]:
    """(domain skills, tools). A skill is a tool when it contains a tool name, as a substring
    by default (so the one-letter name claims many skills), or as a whole word.
    """
    if whole_word:
        pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(vocab.TOOL_TOKENS) + r")(?![\p{L}\p{N}])"

        def is_tool(s: Column) -> Column:
            return F.lower(s).rlike(pattern)
    else:

        def is_tool(s: Column) -> Column:
            return contains_any(F.lower(s), vocab.TOOL_TOKENS)

    cleaned = non_empty(skills)
    return (
        dedupe_ignoring_case(F.filter(cleaned, lambda s: ~is_tool(s))),
        dedupe_ignoring_case(F.filter(cleaned, is_tool)),
    )


def credentials(family: Column) -> Column:
    """Credentials of the family that resume or bio mention, upper case."""
    text = F.lower(F.concat_ws(" ", text_of(F.col("resume")), text_of(F.col("bio"))))

    table = term_table(vocab.FAMILY_CREDENTIALS)
    known = let(family, lambda name: F.flatten(F.filter(table, lambda row: row["key"] == name)["terms"]))
    found = let(text, lambda low: F.filter(known, lambda p: F.contains(low, p)))
    return F.transform(found, F.upper)


def pay_preference() -> Column:
    stated = strip(F.lower(text_of(F.col("intern_pay_preference"))))
    return (
        F.when(is_one_of(stated, vocab.INTERN_PAY_PREFERENCES), stated)
        .when(F.coalesce(F.col("monthly_stipend"), F.lit(0)) != 0, "paid_only")
        .otherwise("no_preference")
    )


def normalize_profiles(profiles: DataFrame, whole_word_tools: bool = False) -> DataFrame:
    """One intent row per profile; row-local, so profiles scale like any other table."""
    p = profiles.withColumn("_family", role_family())
    skills = F.filter(_array("desired_skills"), lambda s: strip(s) != "")
    domain, tools = split_skills_tools(skills, whole_word_tools)
    dealbreakers = dedupe_ignoring_case(F.concat(non_empty(F.col("title_blocklist")), non_empty(F.col("hard_no_keywords"))))
    keywords = dedupe_ignoring_case(F.concat(_array("titles"), _array("desired_skills")))
    return p.select(
        "profile",
        F.coalesce("name", F.lit("Candidate")).alias("profile_name"),
        F.col("_family").alias("role_family"),
        dedupe_ignoring_case(F.col("titles")).alias("target_roles"),
        seniority().alias("seniority"),
        F.coalesce("yoe", F.lit(0.0)).alias("years_experience"),
        dedupe_ignoring_case(F.col("industries")).alias("industries"),
        domain.alias("domain_skills"),
        tools.alias("tools"),
        credentials(F.col("_family")).alias("credentials"),
        dedupe_ignoring_case(F.col("education")).alias("education"),
        dedupe_ignoring_case(F.col("preferred_locations")).alias("locations"),
        F.coalesce("remote_ok", F.lit(True)).alias("remote_ok"),
        F.struct("min_salary", "monthly_stipend", "intern_pay_preference").alias("compensation"),
        F.slice(dealbreakers, 1, 8).alias("dealbreakers"),
        dedupe_ignoring_case(F.col("nice_to_haves")).alias("nice_to_haves"),
        strip(F.lower(F.coalesce("job_type", F.lit("fulltime")))).alias("job_type"),
        F.slice(keywords, 1, 20).alias("raw_keywords"),
    )


def structured_profiles(profiles: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Profile facts for scoring: extracted values where given, configuration where it decides.

    ``extracted`` has (profile, name, yoe text, current_title, core_skills). Roles, salary,
    remote preference, locations and kind of job always come from the configuration.
    """
    config = profiles.select(
        "profile",
        F.coalesce("name", F.lit("Candidate")).alias("c_name"),
        F.coalesce(F.col("yoe").cast("int"), F.lit(2)).alias("c_yoe"),
        _array("desired_skills").alias("c_skills"),
        _array("titles").alias("target_roles"),
        F.when(F.col("job_type") == "internship",
               F.when(pay_preference() == "paid_only", F.nullif("monthly_stipend", F.lit(0))))
        .otherwise(F.col("min_salary")).alias("target_salary"),
        F.initcap(F.coalesce("remote_ok", F.lit(True)).cast("string")).alias("remote_preference"),
        _array("preferred_locations").alias("preferred_locations"),
        F.coalesce("job_type", F.lit("fulltime")).alias("job_type"),
        F.when(F.col("job_type") == "internship", pay_preference()).alias("intern_pay_preference"),
    )
    if extracted is None:
        named = config.withColumns({"name": F.lit(None).cast("string"), "x_yoe": F.lit(None).cast("string"),
                                    "current_title": F.lit(None).cast("string"),
                                    "core_skills": F.lit(None).cast("array<string>"), "has": F.lit(None).cast("boolean")})
    else:
        values = extracted.select(
            "profile", "name", F.col("yoe").cast("string").alias("x_yoe"), "current_title", "core_skills",
            F.lit(True).alias("has"),
        )
        named = config.join(values, "profile", "left")
    known = F.col("has").isNotNull()
    whole = F.when(F.col("x_yoe").rlike(r"^\s*[+-]?\d+\s*$"), strip(F.col("x_yoe"))).try_cast("int")
    yoe = F.when(known, F.coalesce(whole, F.lit(0))).otherwise(F.col("c_yoe"))
    return named.select(
        "profile",
        F.when(known, text_of(F.col("name"))).otherwise(F.col("c_name")).alias("name"),
        F.greatest(F.lit(0), yoe).alias("yoe"),
        text_of(F.col("current_title")).alias("current_title"),
        dedupe_exact(F.when(known, F.col("core_skills")).otherwise(F.col("c_skills"))).alias("core_skills"),
        "target_roles", "target_salary", "remote_preference", "preferred_locations", "job_type",
        "intern_pay_preference",
    )


# ---- query texts ---------------------------------------------------------------------------


def _join_first(arr: Column, n: int) -> Column:
    return F.array_join(F.slice(arr, 1, n), ", ")


def _sentence(prefix: str, body: Column) -> Column:
    return let(body, lambda b: F.when(b != "", F.concat(F.lit(prefix), b, F.lit("."))))


def match_query(user_text: Column | None = None, profile_context: bool = True, query_context: bool = True) -> Column:
    """The sentence a reranker reads, from the columns of an intent row."""
    user = strip(text_of(user_text)) if user_text is not None else F.lit("")
    intern = F.col("job_type") == "internship"
    roles = F.when(F.size("target_roles") > 0, _join_first(F.col("target_roles"), 4)).otherwise("relevant")
    opening = F.concat(
        F.lit("Candidate seeking "), F.when(intern, "internship").otherwise("full-time"), F.lit(" "), roles,
        F.lit(" roles."),
    )
    years = F.when(
        F.col("years_experience") != 0,
        F.concat(
            F.lit("Experience: "), F.rint("years_experience").cast("bigint").cast("string"), F.lit(" years.")
        ),
    )
    skills = _join_first(dedupe_ignoring_case(F.concat("domain_skills", "tools")), 8)
    places = _join_first(F.col("locations"), 2)
    has_places = F.size("locations") > 0
    where = (
        F.when(F.col("remote_ok") & has_places, F.concat(F.lit("remote or "), places))
        .when(F.col("remote_ok"), "remote-friendly")
        .when(has_places, places)
    )
    stipend, salary = F.col("compensation.monthly_stipend"), F.col("compensation.min_salary")
    pay = F.when(
        intern & (F.col("compensation.intern_pay_preference") == "paid_only"),
        F.when(
            F.coalesce(stipend, F.lit(0)) != 0,
            F.concat(F.lit("paid internships $"), F.format_number(stipend, 0), F.lit("/mo+")),
        ).otherwise("paid internships only"),
    ).when(
        ~intern & (F.coalesce(salary, F.lit(0)) != 0),
        F.concat(F.lit("compensation $"), F.format_number(salary, 0), F.lit("+")),
    )
    avoid = dedupe_ignoring_case(
        F.transform(F.slice("dealbreakers", 1, 4), lambda d: strip(F.replace(d, F.lit("required"), F.lit(""))))
    )
    parts = []
    if profile_context:
        parts += [
            opening, years, _sentence("Skills: ", skills),
            _sentence("Credentials: ", _join_first(F.col("credentials"), 3)),
            _sentence("Preferences: ", F.concat_ws(", ", where, pay)),
            _sentence("Avoid: ", _join_first(avoid, 4)),
        ]
    if query_context:
        parts.append(_sentence("User intent: ", user))
    return F.concat_ws(" ", *parts)


def recall_query() -> Column:
    """The compact token form used to look vectors up, from the columns of an intent row."""
    tokens = F.concat(
        F.slice("target_roles", 1, 4),
        F.slice(F.concat("domain_skills", "tools"), 1, 8),
        F.when(F.col("remote_ok"), F.array(F.lit("remote"))).otherwise(empty_strings()),
        F.slice("locations", 1, 2),
        F.when(F.col("job_type") == "internship", F.array(F.lit("internship"))).otherwise(F.array(F.lit("full-time"))),
    )
    return F.array_join(dedupe_ignoring_case(tokens), " ")


def vector_query(user_text: Column) -> Column:
    return F.coalesce(filled(strip(text_of(user_text))), recall_query())

