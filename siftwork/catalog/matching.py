"""Retrieval and reranking; every stored vector is also a request of its profile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.catalog.core import Inputs, any_in, query, quoted, round4_sql, sql_list
from siftwork.functions import vectors as V
from siftwork.operators import ivf as I
from siftwork.operators import rerank as R
from siftwork.operators import retrieval as N
from siftwork.plans.matching import match_requests, semantic_match
from siftwork.session import shared_dir

# ---- retrieval -----------------------------------------------------------------------------


def _dist_sql(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    dot = f"list_dot_product({x}, {y})"
    return f"round(1e0 - {dot} / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y}))), 9)"


def _hits_sql(chunks: str, requests: str, k: int) -> str:
    """Top k chunks per request, then the floor."""
    return f"""d AS (SELECT q.query_id, q.query_text, q.profile, c.uid, c.job_id, c.chunk_key, c.chunk_order, c.chunk_text, c.title, c.company, c.source,
  {_dist_sql('c.embedding', 'q.query_vec')} AS distance FROM {requests} q JOIN {chunks} c ON c.profile = q.profile),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, uid) AS rank FROM d),
hits AS (SELECT *, greatest(0e0, least(1e0, 1e0 - distance)) AS similarity FROM k WHERE rank <= {k} AND greatest(0e0, least(1e0, 1e0 - distance)) >= 0.05e0)"""


@query(
    "vector_distance",
    """
WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 4) AS cosine,
  round(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y), 4) AS l2sq,
  round(greatest(0, 1 - (1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))))), 4) AS similarity FROM p
""",
)
def _(t: Inputs) -> DataFrame:
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cosine = V.distance(F.col("embedding"), F.col("other"))
    l2sq = V.distance(F.col("embedding"), F.col("other"), "l2sq")
    return t.embeddings.join(following, "vec_id").select(
        "vec_id", F.round(cosine, 4).alias("cosine"), F.round(l2sq, 4).alias("l2sq"),
        F.round(V.similarity(cosine), 4).alias("similarity"),
    )


@query(
    "nearest",
    f"WITH {_hits_sql('v_chunks', 'v_requests', 7)} SELECT query_id, uid, rank, round(distance, 9) + 0e0 AS distance FROM k WHERE rank <= 7",
)
def _(t: Inputs) -> DataFrame:
    found = N.nearest(t.chunks, t.requests, 7)
    return found.select("query_id", "uid", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 9).alias("distance"))


@query(
    "nearest_by_shuffle",
    f"WITH {_hits_sql('v_chunks', 'v_requests', 7)} SELECT query_id, uid, rank, round(distance, 9) + 0e0 AS distance FROM k WHERE rank <= 7",
)
def _(t: Inputs) -> DataFrame:
    found = N.nearest(t.chunks, t.requests, 7, broadcast_queries=0)
    return found.select("query_id", "uid", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 9).alias("distance"))


@query(
    "nearest_l2sq",
    """
WITH d AS (SELECT q.query_id, c.uid, round(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y), 9) AS distance
  FROM (SELECT *, CAST(query_vec AS DOUBLE[]) AS y FROM v_requests) q JOIN (SELECT *, CAST(embedding AS DOUBLE[]) AS x FROM v_chunks) c ON c.profile = q.profile),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, uid) AS rank FROM d)
SELECT query_id, uid, rank FROM k WHERE rank <= 5
""",
)
def _(t: Inputs) -> DataFrame:
    found = N.nearest(t.chunks, t.requests, 5, "l2sq")
    return found.select("query_id", "uid", F.col("rank").cast("bigint").alias("rank"))


@query(
    "similar_chunks",
    f"WITH {_hits_sql('v_chunks', 'v_requests', 50)} SELECT query_id, uid, job_id, chunk_key, title, round(similarity, 9) AS similarity FROM hits",
)
def _(t: Inputs) -> DataFrame:
    hits = N.similar_chunks(t.chunks, t.requests)
    return hits.select("query_id", "uid", "job_id", "chunk_key", "title", F.round("similarity", 9).alias("similarity"))


@query(
    "similar_chunks_filtered",
    f"""WITH f AS (SELECT * FROM v_chunks WHERE source = 'lever' AND chunk_key = 'requirements'),
{_hits_sql('f', 'v_requests', 10)} SELECT query_id, uid, source FROM hits""",
)
def _(t: Inputs) -> DataFrame:
    hits = N.similar_chunks(t.chunks, t.requests, 10, {"source": "lever", "chunk_key": "requirements"})
    return hits.select("query_id", "uid", "source")


def _weight_sql() -> str:
    pay = any_in("lower(query_text)", vocab.PAY_QUERY_TERMS)
    rest = " ".join(f"WHEN {quoted(s)} THEN {w}e0" for s, w in vocab.RETRIEVAL_WEIGHTS.items())
    return (
        f"CASE WHEN chunk_key = 'compensation' AND {pay} THEN 1.05e0 WHEN chunk_key = 'benefits' AND {pay} THEN 1e0 "
        f"ELSE CASE chunk_key {rest} ELSE 1e0 END END"
    )


@query("section_weights", f"SELECT q.query_id, c.uid, {_weight_sql()} AS weight FROM v_requests q JOIN v_chunks c ON c.job_id = concat('doc_', floor(CAST(q.query_id AS BIGINT) / 5)::BIGINT)")
def _(t: Inputs) -> DataFrame:
    asked = t.requests.select(
        "query_id", "query_text", F.concat(F.lit("doc_"), F.floor(F.col("query_id").cast("bigint") / 5).cast("string")).alias("job_id")
    )
    weight = V.retrieval_weight(F.col("chunk_key"), F.col("query_text"))
    return t.chunks.select("uid", "job_id", "chunk_key").join(asked, "job_id").select("query_id", "uid", weight.alias("weight"))


def _jobs_sql(chunks: str, requests: str, k: int) -> str:
    return f"""{_hits_sql(chunks, requests, k)},
w AS (SELECT *, {round4_sql(f'least(1e0, similarity * {_weight_sql()})')} AS weighted,
  row_number() OVER (PARTITION BY query_id, job_id ORDER BY rank) AS rn FROM hits),
j AS (SELECT query_id, profile, job_id, max(CASE WHEN rn = 1 THEN title END) AS title, max(CASE WHEN rn = 1 THEN similarity END) AS best_sim,
  max(CASE WHEN rn = 1 THEN weighted END) AS w1, max(CASE WHEN rn = 2 THEN weighted END) AS w2, max(CASE WHEN rn = 3 THEN weighted END) AS w3,
  count(*) AS n, count(DISTINCT CASE WHEN rn <= 3 THEN chunk_key END) AS sections,
  string_agg(CASE WHEN rn <= 3 THEN chunk_key END, '|' ORDER BY rn) AS matched,
  string_agg(CASE WHEN rn <= 5 THEN concat(chunk_key, '=', CAST(round_even(weighted * 10000e0, 0) AS BIGINT)) END, '|' ORDER BY rn) AS chunk_scores,
  max(CASE WHEN rn = 1 THEN chunk_key END) AS k1, max(CASE WHEN rn = 2 THEN chunk_key END) AS k2 FROM w GROUP BY 1, 2, 3),
jobs AS (SELECT *, {round4_sql('best_sim')} AS best_similarity, {round4_sql(
    "least(1e0, w1 * 0.75e0 + ((0e0 + w1 + coalesce(w2, 0e0) + coalesce(w3, 0e0)) / least(3, n)) * 0.20e0 + least(sections / 3e0, 1e0) * 0.05e0)")}
    AS aggregate_score, CASE WHEN n = 1 THEN concat('Best semantic match came from the ', k1, ' section.')
    ELSE concat('Best semantic match came from the ', k1, ' section, with supporting evidence in ', k2, '.') END AS reason FROM j)"""


def _ranked_jobs_sql(chunks: str, requests: str, k: int, n: int) -> str:
    return f"""{_jobs_sql(chunks, requests, k)},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY aggregate_score DESC, best_similarity DESC, job_id) AS job_rank FROM jobs),
kept AS (SELECT * FROM top WHERE job_rank <= {n})"""


def _job_columns(rows: DataFrame) -> DataFrame:
    scores = F.transform(
        "chunk_scores",
        lambda c: F.concat(c["chunk_key"], F.lit("="), F.rint(c["weighted_similarity"] * 10000.0).cast("bigint").cast("string")),
    )
    return rows.select(
        "query_id", "job_id", "title", "best_similarity", "aggregate_score", F.array_join("matched_chunks", "|").alias("matched"),
        F.array_join(scores, "|").alias("chunk_scores"), F.col("retrieval_reason").alias("reason"),
    )


_JOB_FIELDS = "query_id, job_id, title, best_similarity, aggregate_score, matched, chunk_scores, reason"


@query("similar_jobs", f"WITH {_ranked_jobs_sql('v_chunks', 'v_requests', 50, 30)} SELECT {_JOB_FIELDS} FROM kept")
def _(t: Inputs) -> DataFrame:
    return _job_columns(N.similar_jobs(t.chunks, t.requests))


@query("similar_jobs_grouped", f"WITH {_ranked_jobs_sql('v_grouped_chunks', 'v_grouped_requests', 200, 5)} SELECT {_JOB_FIELDS} FROM kept")
def _(t: Inputs) -> DataFrame:
    return _job_columns(N.similar_jobs(t.grouped_chunks, t.grouped_requests, 200, 5))


@query(
    "build_index_rows",
    """
SELECT concat(c.job_id, ':', c.chunk_key, ':hash_64_v1') AS uid, p.title, coalesce(CAST(s.fit_score AS DOUBLE), 0e0) AS fit_score,
  coalesce(CAST(s.ats_score AS DOUBLE), 0e0) AS ats_score, CAST(len(c.embedding) AS BIGINT) AS dimensions
FROM v_chunks c JOIN v_postings p ON p.profile = c.profile AND p.id = c.job_id LEFT JOIN v_scores s ON s.profile = c.profile AND s.job_id = c.job_id
""",
)
def _(t: Inputs) -> DataFrame:
    from siftwork.operators.chunking import build_index_rows
    from siftwork.operators.review import index_rows

    chunks = t.chunks.drop("title", "company", "source", "url", "uid")
    rows = build_index_rows(index_rows(chunks, t.postings, t.scores, "hash-64/v1"))
    return rows.select("uid", "title", "fit_score", "ats_score", F.col("dimensions").cast("bigint").alias("dimensions"))


@query(
    "dimension_conflicts",
    """SELECT profile, 'm' AS model_name, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most FROM (SELECT profile,
  CASE WHEN profile = 'tenant_1' AND chunk_key = 'benefits' THEN 32 ELSE len(embedding) END AS n FROM v_chunks) x GROUP BY profile HAVING min(n) <> max(n)""",
)
def _(t: Inputs) -> DataFrame:
    from siftwork.operators.chunking import dimension_conflicts

    short = (F.col("profile") == "tenant_1") & (F.col("chunk_key") == "benefits")
    index = t.chunks.select(
        "profile", F.lit("m").alias("model_name"), F.when(short, 32).otherwise(F.size("embedding")).alias("dimensions")
    )
    found = dimension_conflicts(index)
    return found.select("profile", "model_name", *[F.col(c).cast("bigint").alias(c) for c in ("least", "most")])


def _index(t: Inputs) -> I.Index:
    return I.build_index(t.chunks, f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}")


@query("ann_candidates")
def _(t: Inputs) -> DataFrame:
    """Candidates of every request from the probed lists, up to a distance of 0.6."""
    found = I.search_index(_index(t), t.requests, 50, max_distance=0.605)
    return found.where(F.col("distance") <= 0.605).select("query_id", "uid", "distance")


@query("ann_nearest")
def _(t: Inputs) -> DataFrame:
    """Requests whose number is divisible by 50 against all chunks; recall is measured in ``tests/test_search.py``."""
    asked = t.requests.where(F.col("query_id").cast("bigint") % 50 == 0)
    found = I.search_index(_index(t), asked, 10)
    return found.select("query_id", "uid", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 9).alias("distance"))


@query(
    "ann_nearest_all_lists",
    f"WITH {_hits_sql('v_chunks', 'v_requests', 7)} SELECT query_id, uid, rank, round(distance, 9) + 0e0 AS distance FROM k WHERE rank <= 7",
)
def _(t: Inputs) -> DataFrame:
    """With every list probed the index gives the exact answer."""
    index = _index(t)
    found = I.search_index(index, t.requests, 7, index.cells)
    return found.select("query_id", "uid", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 9).alias("distance"))


# ---- reranking -----------------------------------------------------------------------------

# A fixed stand-in for a pair model: a raw score that depends on the item number in the text.
_RAW = "((CAST(regexp_extract(chunk_text, 'Item ([0-9]+)', 1) AS BIGINT) * 37) % 80 - 30) / 10e0"


def _item_scorer(_query, text):
    item = F.regexp_extract(text, r"Item (\d+)", 1).try_cast("bigint")
    return (item * 37 % 80 - 30) / F.lit(10.0)


_INTENT = """mq AS (SELECT q.query_id, concat('Candidate ', q.query_text) AS match_query FROM {requests} q)"""


def _queries(t: Inputs, requests: DataFrame) -> DataFrame:
    """Requests with the intents of their profiles, and a short match query the SQL side can build too."""
    asked = match_requests(t.tenants, requests.drop("query_text"))
    short = F.concat(F.lit("Candidate "), F.coalesce("user_text", F.lit("")))
    return asked.withColumn("query_text", F.coalesce("user_text", F.lit(""))).withColumn("match_query", short)


_PAY = any_in("lower(match_query)", vocab.COMPENSATION_TERMS)
_PERKS = any_in("lower(match_query)", vocab.BENEFITS_TERMS)


def _selected_sql(chunks: str, requests: str, k: int, jobs: int, n: int) -> str:
    priority = " ".join(f"WHEN {quoted(s)} THEN {p}" for s, p in vocab.SECTION_PRIORITY.items())
    return f"""{_ranked_jobs_sql(chunks, requests, k, jobs)}, {_INTENT.format(requests=requests)},
h AS (SELECT w.*, match_query, row_number() OVER (PARTITION BY w.query_id, w.job_id, w.chunk_key ORDER BY w.rank) AS srn
  FROM w JOIN mq ON mq.query_id = w.query_id JOIN kept ON kept.query_id = w.query_id AND kept.job_id = w.job_id),
c AS (SELECT *, CASE WHEN chunk_key = 'requirements' THEN 1 WHEN chunk_key = 'responsibilities' THEN 2 WHEN chunk_key = 'summary' THEN 3
    WHEN chunk_key = 'compensation' AND {_PAY} THEN 4 WHEN chunk_key = 'benefits' AND {_PERKS} THEN 5 ELSE 10 END AS turn,
  CASE WHEN chunk_key = 'compensation' AND {_PAY} THEN 3 WHEN chunk_key = 'benefits' AND {_PERKS} THEN 3 ELSE CASE chunk_key {priority} ELSE 0 END END AS pri
  FROM h WHERE srn = 1 AND NOT (chunk_key = 'benefits' AND NOT {_PERKS} AND similarity < 0.55e0)),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, job_id ORDER BY turn, pri DESC, similarity DESC, chunk_order, chunk_key) AS pick
  FROM c) x WHERE pick <= {n})"""


def _selected(t: Inputs, chunks: DataFrame, requests: DataFrame, k: int, jobs: int, n: int) -> DataFrame:
    queries = _queries(t, requests)
    hits = N.similar_chunks(chunks, queries, k)
    return R.select_chunks(N.top_jobs_per_query(N.roll_up(hits), jobs), queries, n)


@query(
    "select_chunks",
    f"WITH {_selected_sql('v_grouped_chunks', 'v_grouped_requests', 80, 40, 4)} SELECT query_id, job_id, uid, chunk_key, CAST(pick AS BIGINT) - 1 AS pick FROM sel",
)
def _(t: Inputs) -> DataFrame:
    rows = _selected(t, t.grouped_chunks, t.grouped_requests, 80, 40, 4).where("chunk_key IS NOT NULL")
    return rows.select("query_id", "job_id", "uid", "chunk_key", F.col("pick_order").cast("bigint").alias("pick"))


@query(
    "best_per_section",
    f"""WITH {_hits_sql('v_grouped_chunks', 'v_grouped_requests', 80)} SELECT query_id, job_id, chunk_key, uid FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, job_id, chunk_key ORDER BY rank) AS rn FROM hits) x WHERE rn = 1""",
)
def _(t: Inputs) -> DataFrame:
    jobs = N.roll_up(N.similar_chunks(t.grouped_chunks, t.grouped_requests, 80), texts=False)
    return jobs.select("query_id", "job_id", F.explode(R.best_per_section(F.col("hits"))).alias("h")).select(
        "query_id", "job_id", "h.chunk_key", "h.uid"
    )


@query(
    "match_intent",
    f"WITH {_INTENT.format(requests='v_requests')} SELECT query_id, {_PAY} AS pay, {_PERKS} AS perks FROM mq",
)
def _(t: Inputs) -> DataFrame:
    rows = _queries(t, t.requests)
    return rows.select(
        "query_id", R.wants_compensation(F.col("match_query")).alias("pay"), R.wants_benefits(F.col("match_query")).alias("perks")
    )


# Families of the five tenants, from titles, skills, bio and resume.
_FAMILY = "CASE profile WHEN 'tenant_1' THEN 'finance' WHEN 'tenant_2' THEN 'marketing' ELSE 'software_engineering' END"


def _family_weight_sql() -> str:
    rows = []
    for family, weights in vocab.FAMILY_SECTION_WEIGHTS.items():
        for section, weight in weights.items():
            rows.append(f"WHEN family = {quoted(family)} AND chunk_key = {quoted(section)} THEN {weight}e0")
    return (
        f"CASE WHEN chunk_key = 'compensation' AND {_PAY} THEN 1.05e0 WHEN chunk_key = 'benefits' AND ({_PAY} OR {_PERKS}) THEN 1e0 "
        + " ".join(rows) + " ELSE 1e0 END"
    )


def _scored_sql(chunks: str, requests: str, k: int, jobs: int, n: int) -> str:
    return f"""{_selected_sql(chunks, requests, k, jobs, n)},
raw AS (SELECT *, {_RAW} AS raw_score FROM sel),
rs AS (SELECT raw.*, f.family, {round4_sql('1e0 / (1e0 + exp(-raw_score))')} AS normalized,
  {round4_sql(f'least(1e0, (1e0 / (1e0 + exp(-raw_score))) * {_family_weight_sql()})')} AS rerank_weighted
  FROM raw JOIN fam f ON f.profile = raw.profile)"""


def _tenant_family_sql() -> str:
    from siftwork.catalog.scoring import FAMILY_SQL

    return FAMILY_SQL.replace("v_candidates", "v_tenants")


@query(
    "rerank_chunks",
    f"""WITH {_tenant_family_sql()}, {_scored_sql('v_grouped_chunks', 'v_grouped_requests', 80, 40, 4)}
SELECT query_id, uid, family, normalized, rerank_weighted AS weighted FROM rs""",
)
def _(t: Inputs) -> DataFrame:
    rows = _selected(t, t.grouped_chunks, t.grouped_requests, 80, 40, 4).where("chunk_key IS NOT NULL")
    scored = R.rerank_chunks(rows, _item_scorer)
    return scored.select(
        "query_id", "uid", F.col("role_family").alias("family"), F.col("normalized_score").alias("normalized"),
        F.col("weighted_score").alias("weighted"),
    )


def _terms_sql() -> str:
    return (
        f"list_filter(regexp_extract_all(match_query, '[A-Za-z][A-Za-z0-9+#./-]{{2,}}'), lambda w: NOT list_contains("
        f"{sql_list(vocab.QUERY_STOPWORDS)}, lower(w)))"
    )


def _final_sql(chunks: str, requests: str) -> str:
    return f"""{_tenant_family_sql()}, {_scored_sql(chunks, requests, 80, 40, 4)},
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, job_id ORDER BY rerank_weighted DESC, normalized DESC, similarity DESC, pick) AS orn FROM rs),
g AS (SELECT query_id, job_id, any_value(match_query) AS match_query, count(*) AS m, max(CASE WHEN orn = 1 THEN rerank_weighted END) AS b1,
    max(CASE WHEN orn = 2 THEN rerank_weighted END) AS b2, max(CASE WHEN orn = 3 THEN rerank_weighted END) AS b3,
    coalesce(max(CASE WHEN chunk_key = 'requirements' THEN rerank_weighted END), 0e0) AS req,
    coalesce(max(CASE WHEN chunk_key = 'responsibilities' THEN rerank_weighted END), 0e0) AS resp,
    coalesce(max(CASE WHEN chunk_key = 'summary' THEN rerank_weighted END), 0e0) AS summ,
    string_agg(chunk_key, '|' ORDER BY orn) AS sections, lower(string_agg(CASE WHEN orn <= 3 THEN chunk_text END, ' ' ORDER BY orn)) AS text3,
    lower(string_agg(chunk_text, ' ' ORDER BY orn)) AS texts FROM o GROUP BY 1, 2),
r AS (SELECT g.*, kept.profile, kept.title, kept.aggregate_score, least(1e0, b1 * 0.55e0 + ((0e0 + b1 + coalesce(b2, 0e0) + coalesce(b3, 0e0)) / least(3, m)) * 0.30e0
    + least(0.10e0, CASE WHEN req >= 0.55e0 AND resp >= 0.55e0 THEN 0.07e0 ELSE 0e0 END + CASE WHEN summ >= 0.50e0 THEN 0.03e0 ELSE 0e0 END)) AS rr,
    list_filter({_terms_sql()}, lambda w: contains(text3, lower(w))) AS found FROM g JOIN kept ON kept.query_id = g.query_id AND kept.job_id = g.job_id),
fin AS (SELECT *, {round4_sql('rr')} AS rerank_score, {round4_sql('least(1e0, rr + aggregate_score * 0.05e0)')} AS final_score,
    {round4_sql('aggregate_score')} AS vector_score,
    array_to_string(list_filter(found, lambda w, i: list_position(list_transform(found, lambda y: lower(y)), lower(w)) = i)[1:5], ', ') AS terms,
    array_to_string(list_filter([CASE WHEN req >= 0.55e0 THEN 'requirements' END, CASE WHEN resp >= 0.55e0 THEN 'responsibilities' END,
      CASE WHEN summ >= 0.55e0 THEN 'summary' END], lambda s: s IS NOT NULL)[1:2], ' and ') AS strong FROM r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rerank_score DESC, vector_score DESC, job_id) AS final_rank FROM fin)"""


@query(
    "rerank_jobs",
    f"""WITH {_final_sql('v_grouped_chunks', 'v_grouped_requests')} SELECT query_id, job_id, vector_score, rerank_score, final_score, sections,
  CASE WHEN strong = '' THEN 'Moderate semantic match from supporting job sections.'
    WHEN terms <> '' THEN concat('Strong ', strong, ' match for ', array_to_string(string_split(terms, ', ')[1:4], ', '), '.')
    ELSE concat('Strong match in ', strong, '.') END AS reason, CAST(final_rank AS BIGINT) AS final_rank FROM ranked WHERE final_rank <= 15""",
)
def _(t: Inputs) -> DataFrame:
    rows = _selected(t, t.grouped_chunks, t.grouped_requests, 80, 40, 4)
    final = R.rerank_jobs(R.rerank_chunks(rows, _item_scorer), vocab.RERANK_FINAL)
    return final.select(
        "query_id", "job_id", "vector_score", "rerank_score", "final_score", F.array_join("matched_sections", "|").alias("sections"),
        F.col("match_reason").alias("reason"), F.col("final_rank").cast("bigint").alias("final_rank"),
    )


@query(
    "select_for_scoring",
    f"""WITH {_final_sql('v_grouped_chunks', 'v_grouped_requests')} SELECT query_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY final_score DESC, job_id) AS rn FROM ranked WHERE final_rank <= 15 AND final_score >= 0.7e0) x WHERE rn <= 2""",
)
def _(t: Inputs) -> DataFrame:
    rows = _selected(t, t.grouped_chunks, t.grouped_requests, 80, 40, 4)
    final = R.final_top_k(R.rerank_jobs(R.rerank_chunks(rows, _item_scorer)))
    return R.select_for_scoring(final, 0.7, 2).select("query_id", "job_id")


_CONCERNS = f"""array_to_string(list_filter([
  CASE WHEN seniority IN ('entry', 'mid', 'intern') AND contains(lower(title), 'senior') THEN 'Seniority concern: posting appears senior-level'
    WHEN seniority IN ('entry', 'mid', 'intern') AND contains(lower(title), 'manager') THEN 'Seniority concern: posting appears manager-level' END,
  CASE WHEN {any_in('texts', vocab.CLEARANCE_PHRASES)} THEN 'Clearance requirement detected' END,
  CASE WHEN {any_in('texts', vocab.NO_SPONSOR_PHRASES)} THEN 'Work authorization requirement detected' END,
  {", ".join(f"CASE WHEN {any_in('texts', p)} AND NOT contains(lower(credentials), {quoted(label.lower())}) THEN 'Credential may be required: {label}' END" for label, p in vocab.CREDENTIAL_PHRASES.items())},
  CASE WHEN job_type = 'internship' AND contains(texts, 'unpaid') THEN 'Posting may be unpaid (profile requires paid internship)' END,
  CASE WHEN NOT remote_ok AND {any_in('texts', vocab.ONSITE_PHRASES)} AND NOT contains(texts, lower(places[1])) AND NOT contains(texts, lower(places[2]))
    THEN 'Location may not match profile preferences' END], lambda c: c IS NOT NULL)[1:5], '|')"""


def _evidence_sql() -> str:
    from siftwork.catalog.scoring import CREDENTIALS_SQL

    return f"""ev AS (SELECT r.*, job_type, remote_ok, CASE WHEN job_type = 'internship' THEN 'intern' WHEN yoe <= 2 THEN 'entry' WHEN yoe <= 5 THEN 'mid'
    WHEN yoe <= 8 THEN 'senior' ELSE 'staff' END AS seniority, array_to_string({CREDENTIALS_SQL}, '|') AS credentials,
    [coalesce(preferred_locations[1], '#'), coalesce(preferred_locations[2], preferred_locations[1])] AS places FROM r JOIN fam ON fam.profile = r.profile)"""


@query(
    "match_evidence",
    f"""WITH {_final_sql('v_grouped_chunks', 'v_grouped_requests')}, {_evidence_sql()}
SELECT query_id, job_id, {_CONCERNS} AS concerns, contains(texts, 'remote') AND remote_ok AS remote FROM ev""",
)
def _(t: Inputs) -> DataFrame:
    rows = _selected(t, t.grouped_chunks, t.grouped_requests, 80, 40, 4)
    final = R.rerank_jobs(R.rerank_chunks(rows, _item_scorer))
    return final.select(
        "query_id", "job_id", F.array_join("evidence.concerns", "|").alias("concerns"),
        F.array_contains("evidence.positive", "Remote-friendly posting").alias("remote"),
    )


@query(
    "evidence_terms",
    f"WITH {_final_sql('v_grouped_chunks', 'v_grouped_requests')} SELECT query_id, job_id, terms FROM fin",
)
def _(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    rows = _selected(t, t.grouped_chunks, t.grouped_requests, 80, 40, 4).where("chunk_key IS NOT NULL")
    scored = R.rerank_chunks(rows, _item_scorer)
    w = Window.partitionBy("query_id", "job_id").orderBy(
        F.desc("weighted_score"), F.desc("normalized_score"), F.desc("vector_similarity"), "pick_order"
    )
    texts = scored.withColumn("rn", F.row_number().over(w)).groupBy("query_id", "job_id").agg(
        F.any_value("match_query").alias("match_query"), F.array_sort(F.collect_list(F.struct("rn", "chunk_text"))).alias("c")
    )
    terms = R.evidence_terms(F.col("match_query"), F.col("c.chunk_text"))
    return texts.select("query_id", "job_id", F.array_join(terms, ", ").alias("terms"))


@query(
    "vector_fallback",
    f"""WITH {_ranked_jobs_sql('v_chunks', 'v_requests', 50, 30)} SELECT query_id, job_id, aggregate_score AS final_score, aggregate_score AS rerank_score,
  string_split(matched, '|')[1] AS best_chunk_key, reason FROM kept""",
)
def _(t: Inputs) -> DataFrame:
    jobs = N.top_jobs_per_query(N.roll_up(N.similar_chunks(t.chunks, t.requests)))
    return R.vector_fallback(jobs).select(
        "query_id", "job_id", "final_score", "rerank_score", "best_chunk_key", F.col("match_reason").alias("reason")
    )


@query("semantic_match")
def _(t: Inputs) -> DataFrame:
    """Every request against its profile's chunks, with the lexical scorer and full evidence."""
    queries = match_requests(t.tenants, t.requests.drop("query_text"))
    rows = semantic_match(t.chunks, queries)
    return rows.select(
        "query_id", "final_rank", "job_id", "title", "company", "vector_score", "rerank_score", "final_score",
        F.array_join("matched_sections", "|").alias("matched_sections"), "best_chunk_key", "match_reason",
        F.array_join("evidence.positive", "|").alias("positive"), F.array_join("evidence.concerns", "|").alias("concerns"),
        F.array_join("evidence_snippets", "|").alias("snippets"),
    )


@query("semantic_match_encoded")
def _(t: Inputs) -> DataFrame:
    """Document postings cut into sections, encoded, and matched to the profiles' own recall texts."""
    from siftwork.functions.text import chunk_uid
    from siftwork.operators.chunking import chunk_and_embed

    chunks = chunk_and_embed(t.postings)
    meta = t.postings.select("profile", F.col("id").alias("job_id"), "title", "company", "source", "url")
    named = chunks.join(meta, ["profile", "job_id"]).withColumn(
        "uid", chunk_uid(F.col("job_id"), F.col("chunk_key"), F.col("model_name"))
    )
    # The search reads vectors twice and texts once, so the postings are cut and encoded once and kept.
    folder = f"{shared_dir(t.spark)}/chunks-{uuid.uuid4().hex}"
    named.write.parquet(folder)
    requests = t.tenants.select(F.col("profile").alias("query_id"), "profile", F.lit("").alias("user_text"))
    rows = semantic_match(t.spark.read.schema(named.schema).parquet(folder), match_requests(t.tenants, requests))
    return rows.select("query_id", "final_rank", "job_id", "final_score", "match_reason")
