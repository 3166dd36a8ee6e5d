import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import rerank as R
from siftwork.operators import retrieval as N
from siftwork.operators.chunking import build_index_rows, dimension_conflicts
from siftwork.plans.matching import match_requests, semantic_match
from siftwork.sources.tables import replace_group

CHUNK = (
    "profile string, job_id string, uid string, chunk_key string, chunk_order int, chunk_text string, embedding array<float>, "
    "title string, company string, source string, url string"
)


def unit(*v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


@pytest.fixture(scope="module")
def seed(spark):
    rows = [
        ("p", "job-backend", "b1", "requirements", 2, "Python needed", unit(1, 0, 1)),
        ("p", "job-backend", "b2", "responsibilities", 1, "Ship APIs", unit(1, 0, 0)),
        ("p", "job-frontend", "f1", "summary", 0, "Build UI, remote", unit(0, 1, 0)),
        ("p", "job-frontend", "f2", "benefits", 4, "Dental", unit(0, 0.8, 0.2)),
        ("other", "job-x", "x1", "summary", 0, "Elsewhere", unit(1, 0, 1)),
    ]
    return spark.createDataFrame([r + (f"Title {r[1]}", "acme", "lever", "u") for r in rows], CHUNK)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, profile string, query_text string, query_vec array<float>")


def test_round_trip_ranks_the_right_posting_first(spark, seed):
    asked = requests(spark, ("q1", "p", "api", unit(1, 0, 1)), ("q2", "p", "ui", unit(0, 1, 0)))
    rows = N.similar_jobs(seed, asked).where("job_rank = 1").collect()
    top = {r["query_id"]: r for r in rows}
    assert top["q1"]["job_id"] == "job-backend" and "requirements" in top["q1"]["matched_chunks"]
    assert top["q2"]["job_id"] == "job-frontend"
    assert top["q1"]["retrieval_reason"] == (
        "Best semantic match came from the requirements section, with supporting evidence in responsibilities."
    )
    # weighted 1.0 and .7071 * 1.05, two of three sections
    second = round(unit(1, 0, 1)[0] * 1.05, 4)
    assert top["q1"]["aggregate_score"] == round(0.75 + 0.2 * (1 + second) / 2 + 0.05 * 2 / 3, 4)


def test_indexing_twice_keeps_the_rows(spark, seed):
    again = replace_group(seed, seed, ["profile", "job_id"])
    assert again.count() == 5


def test_profiles_do_not_see_each_other(spark, seed):
    hits = N.similar_chunks(seed, requests(spark, ("q", "p", "", unit(1, 0, 1))))
    assert {r["job_id"] for r in hits.collect()} <= {"job-backend", "job-frontend"}


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_both_ways_agree_with_brute_force_under_skew(spark, metric):
    """One profile holds most rows, and a third of them are copies of one vector."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 8)).astype("float32")
    base[100:300] = base[100]
    owner = ["hot" if i < 500 else f"p{i % 4}" for i in range(600)]
    rows = [(owner[i], f"u{i:04d}", base[i].tolist()) for i in range(600)]
    chunks = spark.createDataFrame(rows, "profile string, uid string, embedding array<float>").repartition(7)
    queries = rng.normal(size=(12, 8)).astype("float32")
    queries[0] = base[100]
    asked = requests(spark, *[(f"q{j}", "hot" if j < 8 else f"p{j % 4}", "", queries[j].tolist()) for j in range(12)])

    expected = set()
    for j in range(12):
        mine = [i for i in range(600) if owner[i] == ("hot" if j < 8 else f"p{j % 4}")]
        x, q = base[mine].astype("float64"), queries[j].astype("float64")
        if metric == "cosine":
            d = 1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        else:
            d = (x * x).sum(axis=1) + q @ q - 2 * x @ q
        ranked = sorted(zip(np.round(d, 9), [f"u{i:04d}" for i in mine]))[:20]
        expected |= {(f"q{j}", uid, pos + 1) for pos, (_, uid) in enumerate(ranked)}

    slices = N.SLICE_ROWS, N.QUERY_BLOCK
    N.SLICE_ROWS, N.QUERY_BLOCK = 50, 3
    try:
        for limit in (4096, 0):
            got = N.nearest(chunks, asked, 20, metric, broadcast_queries=limit)
            assert {(r["query_id"], r["uid"], r["rank"]) for r in got.collect()} == expected
    finally:
        N.SLICE_ROWS, N.QUERY_BLOCK = slices


def test_vectors_of_another_length_are_left_out(spark, seed):
    odd = seed.where("uid = 'b1'").withColumns({"uid": F.lit("odd"), "embedding": F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")})
    null = seed.where("uid = 'b1'").withColumns({"uid": F.lit("null"), "embedding": F.lit(None).cast("array<float>")})
    pool = seed.unionByName(odd).unionByName(null)
    for limit in (4096, 0):
        got = N.nearest(pool, requests(spark, ("q", "p", "", unit(1, 0, 1))), 10, broadcast_queries=limit)
        assert {r["uid"] for r in got.collect()} == {"b1", "b2", "f1", "f2"}


def test_filters_and_floor(spark, seed):
    asked = requests(spark, ("q", "p", "", unit(1, 0, 0)))
    hits = {r["uid"] for r in N.similar_chunks(seed, asked).collect()}
    assert hits == {"b1", "b2"}
    only = N.similar_chunks(seed, asked, filters={"chunk_key": "requirements"}).collect()
    assert [r["uid"] for r in only] == ["b1"]


def test_index_rows_fill_blanks(spark):
    df = spark.createDataFrame(
        [("p", "j", "m", "summary", None, " text ", [1.0, 0.0], None), ("p", "j", "m", "benefits", 4, "  ", [1.0], "t")],
        "profile string, job_id string, model_name string, chunk_key string, chunk_order int, chunk_text string, embedding array<float>, title string",
    )
    for c in ("company", "source", "url", "status", "scored_at", "created_at"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumns({"fit_score": F.lit(None).cast("int"), "ats_score": F.lit(7)})
    row = build_index_rows(df).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["uid"], r["title"], r["chunk_order"], r["fit_score"], r["ats_score"], r["dimensions"]) == ("j:summary:m", "", 0, 0.0, 7.0, 2)
    assert dimension_conflicts(build_index_rows(df)).count() == 0


# ---- reranking -----------------------------------------------------------------------------


def hits(spark, *rows):
    """(job, section, order, similarity, text) in order of similarity, with the columns of a hit."""
    data = [("p", "q", "backend", j, s, o, sim, t, i + 1) for i, (j, s, o, sim, t) in enumerate(sorted(rows, key=lambda r: -r[3]))]
    df = spark.createDataFrame(
        data, "profile string, query_id string, query_text string, job_id string, chunk_key string, chunk_order int, similarity double, chunk_text string, rank int"
    )
    return df.withColumns({"uid": F.concat("job_id", "chunk_key"), "title": F.col("job_id"), "company": F.lit("c"), "source": F.lit("s"), "url": F.lit("u")})


def queries(spark, profile_rows, text, **profile):
    asked = spark.createDataFrame([("q", "p", text, [1.0])], "query_id string, profile string, user_text string, query_vec array<float>")
    return match_requests(profile_rows(profile), asked).withColumn("match_query", F.lit(text))


def picks(spark, profile_rows, text, n, *rows):
    jobs = N.roll_up(hits(spark, *rows))
    out = R.select_chunks(jobs, queries(spark, profile_rows, text), n).orderBy("pick_order").collect()
    return [r["chunk_key"] for r in out]


FOUR = [("j", "benefits", 4, 0.98, "b"), ("j", "requirements", 2, 0.81, "r"), ("j", "responsibilities", 1, 0.80, "d"), ("j", "summary", 0, 0.72, "s")]


def test_selection(spark, profile_rows):
    assert picks(spark, profile_rows, "backend", 3, *FOUR) == ["requirements", "responsibilities", "summary"]
    assert picks(spark, profile_rows, "dental cover", 4, *FOUR)[3] == "benefits"
    weak = [("j", "benefits", 4, 0.4, "b"), ("j", "compensation", 3, 0.3, "c")]
    assert picks(spark, profile_rows, "backend", 4, *weak) == ["compensation"]
    assert picks(spark, profile_rows, "backend", 4, weak[0]) == [None]
    twice = [("j", "summary", 0, 0.5, "low"), ("j", "summary", 0, 0.9, "high")]
    assert picks(spark, profile_rows, "backend", 4, *twice) == ["summary"]


def reranked(spark, profile_rows, text, rows, raws, title=None, **profile):
    jobs = N.roll_up(hits(spark, *rows))
    if title:
        jobs = jobs.withColumn("title", F.lit(title))
    chosen = R.select_chunks(jobs, queries(spark, profile_rows, text, **profile))
    table = spark.createDataFrame([(j + k, float(v)) for (j, k), v in raws.items()], "uid string, raw_score double")
    scored = R.rerank_chunks(chosen.join(table, "uid", "left"))
    return scored, R.rerank_jobs(scored)


def test_section_weights(spark, profile_rows):
    rows = [("j", "requirements", 2, 0.8, "r"), ("j", "benefits", 4, 0.8, "b"), ("j", "compensation", 3, 0.8, "c")]
    raws = {("j", k): 1.0 for k in ("requirements", "benefits", "compensation")}

    def weights(text):
        return {r["chunk_key"]: r["weighted_score"] for r in reranked(spark, profile_rows, text, rows, raws)[0].collect()}

    plain, paid = weights("backend"), weights("salary")
    assert plain["requirements"] > plain["benefits"]
    assert paid["compensation"] > plain["compensation"] and paid["benefits"] > plain["benefits"]
    assert plain["requirements"] == round(1 / (1 + math.exp(-1)) * 1.2, 4)


def test_strong_posting_first_and_scores(spark, profile_rows):
    rows = [("job-strong", "requirements", 2, 0.8, "python"), ("job-strong", "responsibilities", 1, 0.8, "apis"), ("job-thin", "benefits", 4, 0.9, "dental")]
    raws = {("job-strong", "requirements"): 2.0, ("job-strong", "responsibilities"): 1.8, ("job-thin", "benefits"): 2.0}
    _, jobs = reranked(spark, profile_rows, "backend", rows, raws)
    final = {r["job_id"]: r for r in R.final_top_k(jobs).collect()}
    assert final["job-strong"]["final_rank"] == 1
    # the first chunk reaches 1.0 after weighting; the bonus is added, not multiplied
    second = round(1.15 / (1 + math.exp(-1.8)), 4)
    assert final["job-strong"]["rerank_score"] == round(0.55 + 0.30 * (1 + second) / 2 + 0.07, 4)
    assert final["job-strong"]["match_reason"].startswith("Strong match in requirements and responsibilities")


def test_query_without_any_selected_chunk_keeps_its_vector_result(spark, profile_rows):
    _, jobs = reranked(spark, profile_rows, "backend", [("j", "benefits", 4, 0.4, "b")], {("j", "benefits"): 1.0})
    row = jobs.first()
    assert row["final_score"] == row["vector_score"] > 0 and row["section_scores"] == {"benefits": 0.32}
    assert row["evidence"]["positive"] == []


@pytest.mark.parametrize(
    "title,text,profile,concern",
    [
        ("Senior Backend Engineer", "x", dict(yoe=3.0), "Seniority concern: posting appears senior-level"),
        ("Senior Backend Engineer", "x", dict(yoe=9.0), None),
        ("Engineer", "active security clearance", {}, "Clearance requirement detected"),
        ("Engineer", "no sponsorship", {}, "Work authorization requirement detected"),
        ("Analyst", "CPA required", dict(role_family="finance"), "Credential may be required: CPA"),
        ("Analyst", "CPA required", dict(role_family="finance", resume="holds a CPA"), None),
        ("Intern", "this is unpaid", dict(job_type="internship", intern_pay_preference="paid_only"), "Posting may be unpaid (profile requires paid internship)"),
        ("Engineer", "in-office in Boston", dict(remote_ok=False), "Location may not match profile preferences"),
        ("Engineer", "in-office in Austin, TX", dict(remote_ok=False), None),
    ],
)
def test_concerns(spark, profile_rows, title, text, profile, concern):
    rows = [("j", "requirements", 2, 0.8, text)]
    _, jobs = reranked(spark, profile_rows, "backend", rows, {("j", "requirements"): 1.0}, title, **profile)
    concerns = jobs.first()["evidence"]["concerns"]
    assert (concern in concerns) if concern else concerns == []


def test_positive_evidence(spark, profile_rows):
    rows = [("j", "requirements", 2, 0.8, "Python and remote work in fintech")]
    _, jobs = reranked(spark, profile_rows, "python fintech", rows, {("j", "requirements"): 1.0}, "Backend Engineer", industries=["Fintech"])
    e = jobs.first()["evidence"]
    assert e["positive"] == ["Title match: Software Engineer", "Skills present: python", "Remote-friendly posting", "Industry match: Fintech"]
    assert e["matched_keywords"] == ["python", "fintech"]


def test_select_for_scoring(spark):
    df = spark.createDataFrame([("q", "job-1", 0.91), ("q", "job-2", 0.72), ("q", "job-3", 0.66)], "query_id string, job_id string, final_score double")
    assert [r["job_id"] for r in R.select_for_scoring(df, 0.70, 2).orderBy("score_rank").collect()] == ["job-1", "job-2"]
    assert R.select_for_scoring(df, 0.0, 0).count() == 0


def test_whole_match_with_pair_model_and_without_reranking(spark, seed, profile_rows):
    asked = spark.createDataFrame([("q", "p", "python", unit(1, 0, 1))], "query_id string, profile string, user_text string, query_vec array<float>")
    ready = match_requests(profile_rows(), asked)

    def make_model():
        return lambda query, texts: [float(len(t)) / 10 for t in texts]

    rows = semantic_match(seed, ready, scorer=R.model_scorer(make_model)).orderBy("final_rank").collect()
    assert rows[0]["job_id"] == "job-backend" and rows[0]["evidence_snippets"]
    plain = semantic_match(seed, ready, reranking=False).orderBy("final_rank").collect()
    assert [r["job_id"] for r in plain] == ["job-backend"] + [r["job_id"] for r in plain[1:]]
    assert plain[0]["rerank_score"] == plain[0]["vector_score"] == plain[0]["final_score"]
