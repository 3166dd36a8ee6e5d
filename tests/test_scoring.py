import json

import pytest
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions import scores as S
from siftwork.functions.text import chunk_uid
from siftwork.operators import chunking, intents
from siftwork.operators import scoring as G

DIMS = dict(zip(vocab.DIMENSIONS, (9, 9, 8, 8, 9, 8)))


def parsed(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    return df.select(S.parse_response(F.col("raw")).alias("r")).first()["r"]


def test_parse_plain_fenced_wrapped(spark):
    body = {"disqualified": False, **DIMS, "reasons": list("abcde"), "flags": [], "one_liner": "ok"}
    wrapped = {k: {"value": v} for k, v in body.items()}
    for raw in (json.dumps(body), "```json\n" + json.dumps(body, indent=1) + "\n```", json.dumps(wrapped), json.dumps({"value": wrapped})):
        r = parsed(spark, raw)
        assert {d: r[d] for d in DIMS} == DIMS
        assert r["reasons"] == list("abcd") and r["one_liner"] == "ok" and not r["disqualified"]


def test_parse_clamps_and_zeroes(spark):
    r = parsed(spark, json.dumps({"role_fit": 15, "stack_match": -3, "seniority": 7.9, "location": "6", "growth": "7.9", "compensation": None}))
    assert [r[d] for d in vocab.DIMENSIONS] == [10, 0, 7, 6, 0, 0]
    out = parsed(spark, json.dumps({"disqualified": True, "disqualify_reason": "visa", **DIMS}))
    assert all(out[d] == 0 for d in vocab.DIMENSIONS) and out["disqualify_reason"] == "visa"
    assert parsed(spark, "no json") is None and parsed(spark, "[1, 2]") is None


RECOVER = [
    ('[{"name": "S", "parameters": {"a": 1}}]', {"a": "1"}),
    ('[{"name": "S", "a": {"value": 2}}]', {"a": "2"}),
    ('{"parameters": {"a": 3}}', {"a": "3"}),
    ('{"a": 4}', {"a": "4"}),
    ("[{'name': 'S', 'parameters': {'a': 'x', 'ok': True, 'n': None}}]", {"a": "x", "ok": "true", "n": None}),
    ("[]", None), ("{}", None), ("nothing", None),
]


@pytest.mark.parametrize("payload,fields", RECOVER)
def test_recover_generation(spark, payload, fields):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(S.recover_generation(F.col("p"))).first()[0] == fields


def test_wrapped_values_are_unwrapped_however_deep(spark):
    value = "9"
    for _ in range(6):
        value = '{"value": ' + value + "}"
    row = spark.range(1).select(S.unwrap_value(F.lit(value)).alias("v"), S.unwrap_value(F.lit("plain")).alias("p"), S.unwrap_value(F.lit(None).cast("string")).alias("n")).first()
    assert tuple(row) == ("9", "plain", None)


def test_blanks_before_a_quote_do_not_matter(spark):
    text = "{'one_liner':" + " " * 20 + "'fine', 'disqualified':" + "\n" * 12 + "False}"
    assert spark.range(1).select(S.recover_generation(F.lit(text))).first()[0] == {"one_liner": "fine", "disqualified": "false"}


def test_fit_score_is_rounded_from_doubles(spark):
    weights = {d: F.lit(w) for d, w in vocab.DIMENSION_WEIGHTS.items()}
    fit = S.fit_score({d: F.lit(v) for d, v in DIMS.items()}, weights, F.lit(False))
    assert spark.range(1).select(fit).first()[0] == 86
    assert spark.range(1).select(S.fit_score({d: F.lit(10) for d in DIMS}, weights, F.lit(True))).first()[0] == 0


def brute_ats(text, resume, skills):
    import re

    text, resume = text.lower(), resume.lower()
    words = set(re.findall(r"\b[a-z][a-z0-9+#.\-]{2,}\b", text)) - set(vocab.ATS_STOPWORDS)
    base = sum(w in resume for w in words) / len(words) if words else 0
    lowered = [s.lower() for s in skills]
    both = sum(s in text and s in resume for s in lowered) / len(lowered) if lowered else 0
    return min(100, int((base * 0.6 + both * 0.4) * 100)), [s for s in lowered if s in text and s not in resume][:5]


def test_ats_against_brute_force_on_whole_texts(spark):
    from tests.conftest import DATA

    from siftwork.catalog.core import Inputs

    t = Inputs(spark, DATA)
    skills = t.tenants.select("profile", "resume", "desired_skills")
    score, misses = S.ats_score(F.col("raw_text"), F.col("resume"), F.col("desired_skills"))
    rows = t.postings.join(skills, "profile").select("raw_text", "resume", "desired_skills", score.alias("s"), misses.alias("m"))
    for r in rows.collect():
        assert (r["s"], r["m"]) == brute_ats(r["raw_text"], r["resume"], r["desired_skills"])


def test_prescore_title_exception(spark, profile_rows):
    rows = [("p", "1", "Software Engineer - Early Career", "nothing"), ("p", "2", "Cook", "Python and nothing"), ("p", "3", "Cook", "")]
    df = spark.createDataFrame(rows, "profile string, id string, title string, raw_text string").withColumns(
        {"scrape_qualified": F.lit(True), "scrape_filter_reason": F.lit("")}
    )
    got = {r["id"]: (r["prescore"], r["gate_flag"]) for r in G.gate(df, profile_rows()).collect()}
    assert got == {"1": (1.0, None), "2": (0.5, None), "3": (0.0, "no skill overlap")}


def test_score_batch(spark, profile_rows):
    rows = [("p", str(i), "Software Engineer", "python work", i != 4, "" if i != 4 else "yoe_max: 9 > 5") for i in range(1, 6)]
    postings = spark.createDataFrame(rows, "profile string, id string, title string, raw_text string, scrape_qualified boolean, scrape_filter_reason string")
    responses = spark.createDataFrame(
        [("p", "1", json.dumps(DIMS)), ("p", "2", "broken"), ("p", "3", json.dumps({"disqualified": True, "disqualify_reason": "visa"}))],
        "profile string, id string, raw string",
    )
    p = profile_rows(dict(resume="python docker work"))
    got = {r["job_id"]: r for r in G.score_batch(postings, p, responses).collect()}
    assert got["1"]["fit_score"] == 86 and got["1"]["ats_score"] > 0
    assert got["2"]["flags"] == ["parse error"] and got["2"]["fit_score"] == 0
    assert got["3"]["disqualified"] and got["3"]["flags"] == ["disqualified: visa"]
    assert got["4"]["flags"] == ["scrape_filtered: yoe_max: 9 > 5"] and got["4"]["ats_score"] == 0
    assert "5" not in got
    assert [r["id"] for r in G.failed_responses(postings, p, responses).collect()] == ["5"]


def test_wrong_weights_fail_the_reading_job(spark, profile_rows):
    good = profile_rows()
    assert G.checked_weights(good).first()["valid"]
    bad = good.withColumn("weights", F.struct(*[F.lit(0.5).alias(d) for d in vocab.DIMENSIONS]))
    assert not G.validate_weights(bad).first()["valid"]
    with pytest.raises(Exception, match="weights must sum"):
        G.checked_weights(bad).collect()


def test_call_scorer_runs_after_the_gate(spark):
    def make():
        return lambda batch: [f"{t}!" for t in batch["title"]]

    df = spark.createDataFrame([("p", "1", "a", "b")], "profile string, id string, title string, raw_text string")
    assert G.call_scorer(df, make).collect()[0]["raw"] == "a!"


# ---- sections ------------------------------------------------------------------------------

BODY = """About the role
We build a data product.

Responsibilities:
- ship services
- own pipelines

Requirements
Python and SQL skills.

Compensation
Salary range 100-120.

Benefits:
Medical, 401k and PTO."""


def posting(spark, raw, **over):
    base = dict(profile="p", id="j", title="Engineer", company="Acme", location="Remote", raw_text=raw, **over)
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))


def test_five_sections_in_order(spark):
    raw = "Title: Engineer\nCompany: Acme Inc\nLocation: Remote\nURL: u\n\nDescription:\n" + BODY
    rows = chunking.section_chunks(posting(spark, raw)).orderBy("chunk_order").collect()
    assert [r["chunk_key"] for r in rows] == vocab.SECTIONS
    assert rows[1]["chunk_text"] == "Title: Engineer\nCompany: Acme Inc\nLocation: Remote\nSection: responsibilities\nResponsibilities:\n- ship services\n- own pipelines"


def test_headers_fallbacks_and_limit(spark):
    first = chunking.section_chunks(posting(spark, "zzz\n\nqqq")).collect()
    assert {r["chunk_key"] for r in first} == {"summary", "requirements"}
    preferred = chunking.section_chunks(posting(spark, "intro words\n\nNice to have:\nRust")).collect()
    assert any(r["chunk_key"] == "requirements" and "Rust" in r["chunk_text"] for r in preferred)
    empty = chunking.section_chunks(posting(spark, "")).collect()
    assert [(r["chunk_key"], r["chunk_order"]) for r in empty] == [("summary", 0)]
    long = chunking.section_chunks(posting(spark, "about us " + "w " * 3000)).collect()
    assert len(long[0]["chunk_text"].split("Section: summary\n")[1]) <= 1400


def test_every_block_lands_in_exactly_one_section(spark):
    from siftwork.functions.sections import split_blocks

    df = posting(spark, BODY)
    blocks = df.select(F.explode(split_blocks(F.col("raw_text"))).alias("b")).count()
    chunks = chunking.section_chunks(df, 10**6)
    assert sum(r["chunk_text"].count("\n\n") + 1 for r in chunks.collect()) == blocks


def test_encoders_give_unit_vectors(spark):
    chunks = chunking.section_chunks(posting(spark, BODY))

    def make():
        return lambda texts: [[float(len(x)), 3.0] for x in texts]

    for embedded in (chunking.embed_chunks(chunks), chunking.embed_chunks(chunks, "two", make)):
        for r in embedded.collect():
            assert abs(sum(v * v for v in r["embedding"]) - 1.0) < 1e-5
            assert r["dimensions"] == len(r["embedding"])


def test_stored_vectors_that_cannot_be_read(spark):
    df = spark.createDataFrame([("[0.5,1]",), ("oops",), (None,)], "v string")
    assert [r[0] for r in df.select(chunking.decode_vector(F.col("v"))).collect()] == [[0.5, 1.0], [], []]
    assert spark.range(1).select(chunk_uid(F.lit("j"), F.lit("summary"), F.lit("A/b-1"))).first()[0] == "j:summary:a_b_1"


# ---- profiles ------------------------------------------------------------------------------


def test_families(spark, profile_rows):
    rows = [
        dict(profile="software", titles=["Software Engineer"], desired_skills=["Python", "AWS"]),
        dict(profile="finance", titles=["Financial Analyst"], desired_skills=["Excel", "valuation"]),
        dict(profile="marketing", titles=["Growth Marketing Lead"], desired_skills=["SEO"]),
        dict(profile="intern", titles=["Helper"], desired_skills=[], job_type="internship"),
        dict(profile="unknown", titles=["Gardener"], desired_skills=["roses"]),
        dict(profile="explicit", titles=["Software Engineer"], role_family=" Finance "),
    ]
    got = {r["profile"]: r for r in intents.normalize_profiles(profile_rows(*rows)).collect()}
    assert [got[p]["role_family"] for p in ("software", "finance", "marketing", "intern", "unknown", "explicit")] == [
        "software_engineering", "finance", "marketing", "internship", "general", "finance",
    ]
    assert got["intern"]["seniority"] == "intern" and got["software"]["seniority"] == "mid"


def test_one_letter_tool_by_parity_and_whole_word(spark, profile_rows):
    p = profile_rows(dict(desired_skills=["gardening", "painting", "R", "SQL tuning"]))
    loose = intents.normalize_profiles(p).first()
    assert loose["domain_skills"] == ["painting"] and loose["tools"] == ["gardening", "R", "SQL tuning"]
    strict = intents.normalize_profiles(p, whole_word_tools=True).first()
    assert strict["domain_skills"] == ["gardening", "painting"] and strict["tools"] == ["R", "SQL tuning"]


def test_query_texts(spark, profile_rows):
    p = profile_rows(dict(min_salary=120000, desired_skills=["Kubernetes", "mentoning"], title_blocklist=["CPA required", "staff"], hard_no_keywords=[]))
    row = intents.normalize_profiles(p).select(intents.match_query(F.lit("calm team")).alias("q"), intents.recall_query().alias("r")).first()
    assert row["q"] == (
        "Candidate seeking full-time Software Engineer, Backend Developer roles. Experience: 3 years. "
        "Skills: mentoning, Kubernetes. Preferences: remote or Austin, TX, compensation $120,000+. "
        "Avoid: CPA, staff. User intent: calm team."
    )
    assert row["r"] == "Software Engineer Backend Developer mentoning Kubernetes remote Austin, TX full-time"


def test_structured_profile_overrides(spark, profile_rows):
    p = profile_rows(dict(profile="a", job_type="internship", monthly_stipend=2000), dict(profile="b", min_salary=9, titles=["T"]))
    extracted = spark.createDataFrame(
        [("b", "Bo", "-4", "Dev", ["x", "x", " "])], "profile string, name string, yoe string, current_title string, core_skills array<string>"
    )
    got = {r["profile"]: r for r in intents.structured_profiles(p, extracted).collect()}
    assert got["a"]["target_salary"] == 2000 and got["a"]["intern_pay_preference"] == "paid_only" and got["a"]["yoe"] == 3
    assert (got["b"]["name"], got["b"]["yoe"], got["b"]["core_skills"], got["b"]["target_roles"]) == ("Bo", 0, ["x"], ["T"])
