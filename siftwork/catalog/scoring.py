"""Sections, scores and profiles over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.catalog.core import ORACLES, Inputs, any_in, count_in, query, quoted, sql_list, trimmed
from siftwork.functions import scores as S
from siftwork.functions import sections as K
from siftwork.functions.strings import string_array
from siftwork.operators import chunking, intents
from siftwork.operators import scoring as G
from siftwork.operators.calls import answered, missing_calls
from siftwork.plans import rebuild as V
from siftwork.session import shared_dir

# ---- sections ------------------------------------------------------------------------------

_BODY = "substr(raw_text, strpos(raw_text, concat(chr(10), 'Description:', chr(10))) + 14)"
# A block separator is blank-line white space of any length; marking it keeps the split simple.
_BLOCKS = (
    f"list_filter(list_transform(string_split(regexp_replace({trimmed(_BODY)}, '\\n\\s*\\n', chr(1), 'g'), chr(1)), "
    f"lambda b: {trimmed('b')}), lambda b: b <> '')"
)
_HEADER = r"^(?:[-*]\s+)?([A-Za-z][A-Za-z0-9 &/''()-]{1,80}):?\s*$"


def _header_sql(line: str) -> str:
    words = f"len(string_split_regex(trim(regexp_extract({trimmed(line)}, '{_HEADER}', 1)), ' +'))"
    return f"(regexp_matches({trimmed(line)}, '{_HEADER}') AND {words} BETWEEN 1 AND 6)"


def _classify_sql(line: str) -> str:
    head = f"rtrim(lower({trimmed(line)}), ':')"
    whens = " ".join(
        f"WHEN {any_in(head, phrases)} THEN {quoted(vocab.LABEL_SECTION[label])}"
        for label, phrases in vocab.HEADER_PHRASES.items()
    )
    return f"(CASE {whens} END)"


def _section_sql() -> str:
    """Blocks with their section, as common table expressions b (block), v (votes), s (section)."""
    line = "split_part(block, chr(10), 1)"
    votes = ", ".join(
        f"{count_in('lower(block)', K.section_phrases(s))} + CASE WHEN {_header_sql(line)} AND {_classify_sql(line)} = {quoted(s)} "
        f"THEN 3 ELSE 0 END AS v{i}"
        for i, s in enumerate(vocab.SECTIONS)
    )
    top = "greatest(" + ", ".join(f"v{i}" for i in range(5)) + ")"
    whens = " ".join(f"WHEN v{i} = top THEN {quoted(s)}" for i, s in enumerate(vocab.SECTIONS))
    return f"""l AS (SELECT profile, id, title, company, location, raw_text, {_BLOCKS} AS blocks FROM v_postings),
b AS (SELECT profile, id, title, company, location, unnest(blocks) AS block, unnest(range(len(blocks))) AS pos FROM l),
v AS (SELECT *, {votes} FROM b),
s AS (SELECT *, CASE WHEN top = 0 AND pos = 0 THEN 'summary' WHEN top = 0 THEN 'requirements' {whens} END AS section
  FROM (SELECT *, {top} AS top FROM v) x)"""


def _blocks(t: Inputs) -> DataFrame:
    from siftwork.functions.text import description_body

    blocks = K.split_blocks(description_body(F.col("raw_text")))
    return t.postings.select("profile", "id", F.posexplode(blocks).alias("pos", "block"))


@query("split_blocks", f"SELECT id, CAST(len({_BLOCKS}) AS BIGINT) AS blocks, array_to_string({_BLOCKS}, '|') AS joined FROM v_postings")
def _(t: Inputs) -> DataFrame:
    from siftwork.functions.text import description_body

    blocks = K.split_blocks(description_body(F.col("raw_text")))
    return t.postings.select("id", F.size(blocks).cast("bigint").alias("blocks"), F.array_join(blocks, "|").alias("joined"))


_LINES = "SELECT DISTINCT unnest(string_split(raw_text, chr(10))) AS line FROM v_postings"


def _lines(t: Inputs) -> DataFrame:
    return t.postings.select(F.explode(F.split("raw_text", "\n")).alias("line")).distinct()


@query("looks_like_header", f"SELECT line, {_header_sql('line')} AS is_header FROM ({_LINES}) x")
def _(t: Inputs) -> DataFrame:
    return _lines(t).select("line", K.looks_like_header(F.col("line")).alias("is_header"))


@query("classify_header", f"SELECT line, {_classify_sql('line')} AS section FROM ({_LINES}) x")
def _(t: Inputs) -> DataFrame:
    return _lines(t).select("line", K.classify_header(F.col("line")).alias("section"))


@query("assign_section", f"WITH {_section_sql()} SELECT id, CAST(pos AS BIGINT) AS pos, section FROM s")
def _(t: Inputs) -> DataFrame:
    section = K.assign_section(F.col("block"), F.col("pos") == 0)
    return _blocks(t).select("id", F.col("pos").cast("bigint").alias("pos"), section.alias("section"))


_NORMAL = (
    f"array_to_string(list_filter(list_transform(string_split(block, chr(10)), lambda l: {trimmed('l')}), lambda l: l <> ''), chr(10))"
)
_ORDER = "list_position(" + sql_list(vocab.SECTIONS) + ", section) - 1"


@query(
    "section_chunks",
    f"""WITH {_section_sql()},
g AS (SELECT id, title, company, location, section, {trimmed(f"substr(string_agg({_NORMAL}, concat(chr(10), chr(10)) ORDER BY pos), 1, 1400)")} AS body
  FROM s GROUP BY id, title, company, location, section)
SELECT id AS job_id, section AS chunk_key, CAST({_ORDER} AS BIGINT) AS chunk_order, concat('Title: ', title, chr(10), 'Company: ', company,
  chr(10), 'Location: ', location, chr(10), 'Section: ', section, chr(10), body) AS chunk_text FROM g WHERE body <> ''""",
)
def _(t: Inputs) -> DataFrame:
    chunks = chunking.section_chunks(t.postings)
    return chunks.select("job_id", "chunk_key", F.col("chunk_order").cast("bigint").alias("chunk_order"), "chunk_text")


@query("embed_chunks")
def _(t: Inputs) -> DataFrame:
    embedded = chunking.embed_chunks(chunking.section_chunks(t.postings))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return embedded.select("job_id", "chunk_key", "dimensions", F.round(norm, 4).alias("norm"))


def _length_encoder():
    """An encoder for the Arrow path: a few text statistics per chunk."""

    def encode(texts):
        return [[1.0, float(len(x)), float(x.count(" ")), float(x.count("e"))] for x in texts]

    return encode


@query(
    "embed_chunks_with_encoder",
    """
WITH n AS (SELECT uid, chunk_key, job_id, 1e0 AS a, CAST(length(chunk_text) AS DOUBLE) AS b,
  CAST(length(chunk_text) - length(replace(chunk_text, ' ', '')) AS DOUBLE) AS c,
  CAST(length(chunk_text) - length(replace(chunk_text, 'e', '')) AS DOUBLE) AS d FROM v_chunks)
SELECT job_id, chunk_key, round_even(10000 * b / sqrt(a * a + b * b + c * c + d * d), 0) / 10000 AS second, CAST(4 AS BIGINT) AS dimensions FROM n
""",
)
def _(t: Inputs) -> DataFrame:
    chunks = t.chunks.select("profile", "job_id", "chunk_key", "chunk_order", "chunk_text")
    embedded = chunking.embed_chunks(chunks, "lengths", _length_encoder)
    second = F.rint(F.get("embedding", F.lit(1)).cast("double") * 10000.0) / 10000.0
    return embedded.select("job_id", "chunk_key", second.alias("second"), F.col("dimensions").cast("bigint").alias("dimensions"))


ORACLES["embed_chunks_cached"] = ORACLES["embed_chunks_with_encoder"]


@query("embed_chunks_cached")
def _(t: Inputs) -> DataFrame:
    """The same vectors through a table of answers; the second run finds all of them there."""
    chunks = t.chunks.select("profile", "job_id", "chunk_key", "chunk_order", "chunk_text")
    cache = f"{shared_dir(t.spark)}/answers-{uuid.uuid4().hex}"
    chunking.embed_chunks(chunks, "lengths", _length_encoder, cache)
    embedded = chunking.embed_chunks(chunks, "lengths", _length_encoder, cache)
    second = F.rint(F.get("embedding", F.lit(1)).cast("double") * 10000.0) / 10000.0
    return embedded.select("job_id", "chunk_key", second.alias("second"), F.col("dimensions").cast("bigint").alias("dimensions"))


@query(
    "missing_calls",
    """SELECT lower(event_type) AS word, CAST(user_id AS VARCHAR) AS who FROM events WHERE event_type <> 'view'
EXCEPT SELECT lower(event_type), CAST(user_id AS VARCHAR) FROM events WHERE event_type <> 'view' AND event_id % 3 = 0""",
)
def _(t: Inputs) -> DataFrame:
    """Calls that are still to be made after a third of the rows have been answered: distinct inputs only."""
    rows = t.events.where("event_type <> 'view'").select("event_id", F.lower("event_type").alias("word"), F.col("user_id").cast("string").alias("who"))
    cache = f"{shared_dir(t.spark)}/answers-{uuid.uuid4().hex}"
    answered(rows.where("event_id % 3 = 0"), cache, "echo", ["word", "who"], lambda: lambda a, b: [x + y for x, y in zip(a, b)], "string", 64)
    left = missing_calls(rows, cache, "echo", ["word", "who"], "string")
    return left.select(F.col("_in_word").alias("word"), F.col("_in_who").alias("who"))


@query(
    "rebuild_conflicts",
    """SELECT profile, model_name, count(*) AS chunks, CAST(CASE WHEN profile = 'tenant_0' THEN 64 ELSE 4 END AS BIGINT) AS dimensions
FROM v_chunks GROUP BY profile, model_name""",
)
def _(t: Inputs) -> DataFrame:
    """Some vectors are cut short, in all profiles but one: those are re-embedded as a new version."""
    path = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    cut = (F.col("chunk_order") == 1) & (F.col("profile") != "tenant_0")
    rows = t.chunks.withColumn("embedding", F.when(cut, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    rows = rows.withColumn("dimensions", F.size("embedding")).withColumn("version", F.lit(1).cast("long"))
    rows.select(*V._columns(V.ROWS)).write.partitionBy(*V.PARTITIONS).parquet(path)
    rows.select(*V.PARTITIONS).distinct().write.parquet(f"{path}-current")
    V.rebuild_conflicts(t.spark, path, _length_encoder)
    found = V.read_index(t.spark, path).groupBy("profile", "model_name")
    return found.agg(F.count("*").alias("chunks"), F.max("dimensions").cast("bigint").alias("dimensions"))


@query(
    "chunk_and_embed",
    f"""WITH {_section_sql()} SELECT s.id AS job_id, CAST(count(DISTINCT section) AS BIGINT) AS chunks FROM s
JOIN v_scores k ON k.profile = s.profile AND k.job_id = s.id JOIN v_postings p ON p.profile = s.profile AND p.id = s.id
WHERE p.scrape_qualified AND NOT EXISTS (SELECT 1 FROM v_chunks c WHERE c.profile = s.profile AND c.job_id = s.id) GROUP BY s.id""",
)
def _(t: Inputs) -> DataFrame:
    from siftwork.operators.review import pending_embeddings

    due = pending_embeddings(t.postings, t.scores, t.chunks, "hash-64/v1")
    embedded = chunking.chunk_and_embed(due, "hashing-tf-256")
    return embedded.groupBy("job_id").agg(F.count_if(F.size("embedding") > 0).alias("chunks"))


# ---- scores --------------------------------------------------------------------------------

_NORMAL_TITLE = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_PRESCORE = f"""CASE WHEN len(list_filter(titles, lambda x: lower(x) = lower(title) OR ({_NORMAL_TITLE.format('x')} <> ''
    AND contains({_NORMAL_TITLE.format('title')}, {_NORMAL_TITLE.format('x')})))) > 0 THEN 1e0
  WHEN len(desired_skills) > 0 THEN CAST(len(list_filter(desired_skills, lambda k: contains(lower(raw_text), lower(k)))) AS DOUBLE) / len(desired_skills)
  ELSE 0e0 END"""
_POSTED = "v_postings p JOIN v_tenants t ON t.profile = p.profile"


@query("keyword_prescore", f"SELECT id, round({_PRESCORE}, 6) AS prescore FROM {_POSTED}")
def _(t: Inputs) -> DataFrame:
    return G.gate(t.postings, t.tenants).select("id", F.round("prescore", 6).alias("prescore"))


_GATE = f"""CASE WHEN NOT scrape_qualified THEN concat('scrape_filtered: ', scrape_filter_reason)
  WHEN {_PRESCORE} < 0.15e0 THEN 'no skill overlap' END"""


@query("prescore_gate", f"SELECT id, {_GATE} AS flag FROM {_POSTED}")
def _(t: Inputs) -> DataFrame:
    return G.gate(t.postings, t.tenants).select("id", F.col("gate_flag").alias("flag"))


_FIT_TERMS = " + ".join(f"coalesce({d}, 0) * {w}e0" for d, w in vocab.DIMENSION_WEIGHTS.items())
_FIT = f"CAST(least(100, round_even(({_FIT_TERMS}) * 10e0, 0)) AS BIGINT)"


@query("fit_score", f"SELECT job_id, CASE WHEN disqualified THEN 0 ELSE {_FIT} END AS fit FROM v_scores")
def _(t: Inputs) -> DataFrame:
    weights = {d: F.lit(w) for d, w in vocab.DIMENSION_WEIGHTS.items()}
    fit = S.fit_score({d: F.col(d) for d in vocab.DIMENSIONS}, weights, F.col("disqualified"))
    return t.scores.select("job_id", fit.cast("bigint").alias("fit"))


@query("ats_score")
def _(t: Inputs) -> DataFrame:
    skills = t.tenants.select("profile", "resume", "desired_skills")
    score, misses = S.ats_score(F.col("raw_text"), F.col("resume"), F.col("desired_skills"))
    joined = t.postings.select("profile", "id", "raw_text").join(skills, "profile")
    return joined.select("id", score.cast("bigint").alias("ats"), F.array_join(misses, ",").alias("misses"))


_TOKENS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 2))"


@query(
    "token_overlap",
    f"""
WITH w AS (SELECT doc_id, profile, unnest({_TOKENS}) AS w FROM v_postings),
k AS (SELECT w.doc_id, w.w, contains(lower(t.resume), w.w) AS hit FROM w JOIN v_tenants t ON t.profile = w.profile
  WHERE NOT list_contains({sql_list(vocab.ATS_STOPWORDS)}, w.w))
SELECT doc_id, count(*) AS words, count(*) FILTER (hit) AS covered FROM k GROUP BY doc_id
""",
)
def _(t: Inputs) -> DataFrame:
    words = F.array_except(
        F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 2)),
        string_array(vocab.ATS_STOPWORDS),
    )
    joined = t.postings.select("doc_id", "profile", "text").join(t.tenants.select("profile", "resume"), "profile")
    covered = F.filter(words, lambda w: F.contains(F.lower("resume"), w))
    rows = joined.select("doc_id", F.size(words).cast("bigint").alias("words"), F.size(covered).cast("bigint").alias("covered"))
    return rows.where("words > 0")


# Responses of an outside scorer, spelled in the ways such responses come.
def _responses(t: Inputs) -> DataFrame:
    k = F.regexp_extract("job_id", r"(\d+)$", 1).cast("bigint")
    fields = [F.col(d).alias(d) for d in vocab.DIMENSIONS]
    over = F.when(k % 4 == 0, F.col("role_fit") + 5).otherwise(F.col("role_fit")).alias("role_fit")
    plain = F.to_json(
        F.struct(
            F.col("disqualified"), F.when(F.col("disqualified"), F.col("disqualify_reason")).alias("disqualify_reason"),
            over, *fields[1:], string_array(["a", "b", "c", "d", "e"]).alias("reasons"),
            string_array(["check"]).alias("flags"), F.concat(F.lit("One liner "), k.cast("string")).alias("one_liner"),
        )
    )
    wrapped = F.to_json(
        F.struct(
            F.struct(F.col("disqualified").alias("value")).alias("disqualified"),
            F.struct(F.when(F.col("disqualified"), F.col("disqualify_reason")).otherwise("").alias("value")).alias("disqualify_reason"),
            *[F.struct(F.struct(c.alias("value")).alias("value")).alias(n) for c, n in zip([over, *fields[1:]], vocab.DIMENSIONS)],
            F.struct(string_array(["a", "b", "c", "d", "e"]).alias("value")).alias("reasons"),
            F.struct(string_array(["check"]).alias("value")).alias("flags"),
            F.struct(F.concat(F.lit("One liner "), k.cast("string")).alias("value")).alias("one_liner"),
        )
    )
    fenced = F.concat(F.lit("```json\n"), plain, F.lit("\n```"))
    raw = (
        F.when(k % 5 == 0, F.lit("sorry, no JSON")).when(k % 5 == 1, fenced).when(k % 5 == 2, wrapped).otherwise(plain)
    )
    return t.scores.select("profile", F.col("job_id").alias("id"), raw.alias("raw"), k.alias("k"))


_RESPONSE_DIMS = ", ".join(
    f"CASE WHEN disqualified THEN 0 ELSE {('least(10, role_fit + CASE WHEN k % 4 = 0 THEN 5 ELSE 0 END)' if d == 'role_fit' else f'coalesce({d}, 0)')} END AS {d}"
    for d in vocab.DIMENSIONS
)
_RESPONSES = f"""SELECT profile, id, k, k % 5 <> 0 AS valid, out, CASE WHEN out THEN coalesce(disqualify_reason, '') ELSE '' END AS why, {", ".join(vocab.DIMENSIONS)}
FROM (SELECT profile, job_id AS id, k, disqualified AS out, disqualify_reason, {_RESPONSE_DIMS} FROM
  (SELECT *, CAST(regexp_extract(job_id, '([0-9]+)$', 1) AS BIGINT) AS k FROM v_scores) x) y"""


@query(
    "parse_response",
    f"""SELECT id, valid, CASE WHEN valid THEN out END AS disqualified, CASE WHEN valid THEN why END AS reason,
  {", ".join(f"CAST(CASE WHEN valid THEN {d} END AS BIGINT) AS {d}" for d in vocab.DIMENSIONS)},
  CASE WHEN valid THEN 'a,b,c,d' END AS reasons, CASE WHEN valid THEN concat('One liner ', k) END AS one_liner FROM ({_RESPONSES}) r""",
)
def _(t: Inputs) -> DataFrame:
    rows = _responses(t).withColumn("r", S.parse_response(F.col("raw")))
    return rows.select(
        "id", F.col("r").isNotNull().alias("valid"), F.col("r.disqualified").alias("disqualified"),
        F.col("r.disqualify_reason").alias("reason"),
        *[F.col(f"r.{d}").cast("bigint").alias(d) for d in vocab.DIMENSIONS],
        F.array_join("r.reasons", ",").alias("reasons"), F.col("r.one_liner").alias("one_liner"),
    )


@query(
    "score_batch",
    f"""WITH r AS ({_RESPONSES}), g AS (SELECT p.profile, p.id, {_GATE} AS gate FROM {_POSTED}),
j AS (SELECT g.profile, g.id, g.gate, r.k, r.valid, r.out, r.why, {", ".join(f"r.{d}" for d in vocab.DIMENSIONS)} FROM g LEFT JOIN r
  ON r.profile = g.profile AND r.id = g.id WHERE g.gate IS NOT NULL OR r.id IS NOT NULL)
SELECT id AS job_id, CAST(CASE WHEN gate IS NOT NULL OR NOT valid OR out THEN 0 ELSE {_FIT} END AS BIGINT) AS fit,
  CASE WHEN gate IS NOT NULL THEN gate WHEN NOT valid THEN 'parse error' WHEN out THEN concat('disqualified: ', why) ELSE 'check' END AS flags,
  gate IS NULL AND valid AND out AS disqualified, CASE WHEN gate IS NULL AND valid AND out THEN why ELSE '' END AS disqualify_reason,
  CASE WHEN gate IS NULL AND valid AND NOT out THEN concat('One liner ', k) ELSE '' END AS one_liner FROM j""",
)
def _(t: Inputs) -> DataFrame:
    rows = G.score_batch(t.postings, t.tenants, _responses(t))
    return rows.select(
        "job_id", F.col("fit_score").cast("bigint").alias("fit"), F.array_join("flags", ",").alias("flags"), "disqualified",
        "disqualify_reason", "one_liner",
    )


@query(
    "failed_responses",
    f"""SELECT g.id FROM (SELECT p.profile, p.id, {_GATE} AS gate FROM {_POSTED}) g WHERE gate IS NULL
AND NOT EXISTS (SELECT 1 FROM v_scores s WHERE s.profile = g.profile AND s.job_id = g.id)""",
)
def _(t: Inputs) -> DataFrame:
    return G.failed_responses(t.postings, t.tenants, _responses(t)).select("id")


@query(
    "recover_generation",
    """SELECT job_id, CASE CAST(regexp_extract(job_id, '([0-9]+)$', 1) AS BIGINT) % 6 WHEN 5 THEN NULL ELSE CAST(role_fit AS VARCHAR) END AS role_fit,
  CASE CAST(regexp_extract(job_id, '([0-9]+)$', 1) AS BIGINT) % 6 WHEN 5 THEN NULL ELSE 2 END AS fields FROM v_scores""",
)
def _(t: Inputs) -> DataFrame:
    k = F.regexp_extract("job_id", r"(\d+)$", 1).cast("bigint") % 6
    n = F.col("role_fit").cast("string")

    def spelled(template: str):
        before, after = template.split("@")
        return F.concat(F.lit(before), n, F.lit(after))

    payload = (
        F.when(k == 0, spelled('[{"name": "Score", "parameters": {"role_fit": @, "one_liner": "ok"}}]'))
        .when(k == 1, spelled('{"parameters": {"role_fit": {"value": @}, "one_liner": {"value": "ok"}}}'))
        .when(k == 2, spelled('[{"name": "Score", "role_fit": @, "one_liner": "ok"}]'))
        .when(k == 3, spelled("[{'name': 'Score', 'parameters': {'role_fit': @, 'one_liner': 'ok'}}]"))
        .when(k == 4, spelled('{"role_fit": @, "one_liner": "ok"}'))
        .otherwise("not recoverable")
    )
    fields = t.scores.select("job_id", S.recover_generation(payload).alias("f"))
    return fields.select("job_id", F.col("f")["role_fit"].alias("role_fit"), F.size("f").alias("fields")).withColumn(
        "fields", F.when(F.col("fields") >= 0, F.col("fields"))
    )


@query(
    "validate_weights",
    "SELECT profile, round(weight_sum, 6) AS weight_sum, weight_sum BETWEEN 0.99e0 AND 1.01e0 AS valid FROM "
    "(SELECT profile, 0.30e0 + w + 0.20e0 + 0.10e0 + 0.10e0 + 0.05e0 AS weight_sum FROM "
    "(SELECT profile, 0.25e0 + (CAST(regexp_extract(profile, '([0-9]+)$', 1) AS BIGINT) % 5) * 0.004e0 AS w FROM v_candidates) x) y",
)
def _(t: Inputs) -> DataFrame:
    drift = (F.regexp_extract("profile", r"(\d+)$", 1).cast("bigint") % 5) * F.lit(0.004)
    weights = {d: F.lit(w) for d, w in vocab.DIMENSION_WEIGHTS.items()}
    weights["stack_match"] = F.lit(0.25) + drift
    weighted = t.candidates.withColumn("weights", F.struct(*[c.alias(d) for d, c in weights.items()]))
    return G.validate_weights(weighted).withColumn("weight_sum", F.round("weight_sum", 6))


@query(
    "cost_estimate",
    """SELECT provider, CASE WHEN provider IN ('anthropic', 'openai') THEN format('~${:.2f}', count(*) * 0.005e0) ELSE '~$0.00 (free tier)' END AS cost
FROM v_request_log GROUP BY provider""",
)
def _(t: Inputs) -> DataFrame:
    counts = t.request_log.groupBy("provider").agg(F.count("*").alias("n"))
    return counts.select("provider", S.cost_estimate(F.col("provider"), F.col("n")).alias("cost"))


# ---- profiles ------------------------------------------------------------------------------


def _family_sql() -> str:
    text = (
        "lower(concat(array_to_string(titles, ' '), ' ', array_to_string(desired_skills, ' '), ' ', coalesce(bio, ''), ' ', "
        "substr(coalesce(resume, ''), 1, 600)))"
    )
    votes = ", ".join(
        f"2 * {count_in('t', titles)} + {count_in('t', vocab.FAMILY_SKILLS[f])} AS v{i}"
        for i, (f, titles) in enumerate(vocab.FAMILY_TITLES.items())
    )
    top = "greatest(" + ", ".join(f"v{i}" for i in range(len(vocab.FAMILY_TITLES))) + ")"
    whens = " ".join(f"WHEN v{i} = top THEN {quoted(f)}" for i, f in enumerate(vocab.FAMILY_TITLES))
    return f"""fam AS (SELECT *, CASE WHEN trim(lower(coalesce(role_family, ''))) IN ({", ".join(quoted(f) for f in vocab.ROLE_FAMILIES)})
    THEN trim(lower(role_family)) WHEN top = 0 THEN CASE WHEN job_type = 'internship' THEN 'internship' ELSE 'general' END
    WHEN job_type = 'internship' AND top <= 2 THEN 'internship' {whens} END AS family
  FROM (SELECT *, {top} AS top FROM (SELECT *, {votes} FROM (SELECT *, {text} AS t FROM v_candidates) a) b) c)"""


FAMILY_SQL = _family_sql()


@query("role_family", f"WITH {FAMILY_SQL} SELECT profile, family FROM fam")
def _(t: Inputs) -> DataFrame:
    return t.candidates.select("profile", intents.role_family().alias("family"))


@query(
    "seniority",
    """SELECT profile, CASE WHEN job_type = 'internship' THEN 'intern' WHEN yoe <= 2 THEN 'entry' WHEN yoe <= 5 THEN 'mid' WHEN yoe <= 8 THEN 'senior'
  ELSE 'staff' END AS seniority FROM v_candidates""",
)
def _(t: Inputs) -> DataFrame:
    return t.candidates.select("profile", intents.seniority().alias("seniority"))


def dedupe_list_sql(items: str) -> str:
    """Case-insensitive dedupe of a list, first spelling kept."""
    cleaned = f"list_filter(list_transform({items}, lambda x: {trimmed('x')}), lambda x: x <> '')"
    return (
        f"list_filter({cleaned}, lambda x, i: list_position(list_transform({cleaned}, lambda y: lower(y)), lower(x)) = i)"
    )


_IS_TOOL = any_in("lower(s)", vocab.TOOL_TOKENS)
DOMAIN_SQL = dedupe_list_sql(f"list_filter(desired_skills, lambda s: NOT {_IS_TOOL})")
TOOLS_SQL = dedupe_list_sql(f"list_filter(desired_skills, lambda s: {_IS_TOOL})")


@query(
    "split_skills_tools",
    f"SELECT profile, array_to_string({DOMAIN_SQL}, '|') AS domain, array_to_string({TOOLS_SQL}, '|') AS tools FROM v_candidates",
)
def _(t: Inputs) -> DataFrame:
    domain, tools = intents.split_skills_tools(F.col("desired_skills"))
    return t.candidates.select("profile", F.array_join(domain, "|").alias("domain"), F.array_join(tools, "|").alias("tools"))


_CREDENTIALS = "CASE family " + " ".join(
    f"WHEN {quoted(f)} THEN list_transform(list_filter({sql_list(c)}, lambda c: contains(lower(concat(coalesce(resume, ''), ' ', coalesce(bio, ''))), c)), lambda c: upper(c))"
    for f, c in vocab.FAMILY_CREDENTIALS.items()
) + " ELSE [] END"
CREDENTIALS_SQL = _CREDENTIALS


@query("credentials", f"WITH {FAMILY_SQL} SELECT profile, array_to_string({_CREDENTIALS}, '|') AS credentials FROM fam")
def _(t: Inputs) -> DataFrame:
    found = intents.credentials(intents.role_family())
    return t.candidates.select("profile", F.array_join(found, "|").alias("credentials"))


INTENT_SQL = f"""{FAMILY_SQL}, intent AS (SELECT profile, name, family, job_type, yoe, remote_ok, min_salary, monthly_stipend, intern_pay_preference,
  {dedupe_list_sql('titles')} AS roles, {DOMAIN_SQL} AS domain, {TOOLS_SQL} AS tools, {_CREDENTIALS} AS credentials,
  {dedupe_list_sql('preferred_locations')} AS places, ({dedupe_list_sql('list_concat(title_blocklist, hard_no_keywords)')})[1:8] AS avoid,
  ({dedupe_list_sql('list_concat(titles, desired_skills)')})[1:20] AS keywords, {dedupe_list_sql('industries')} AS industries FROM fam)"""


@query(
    "normalize_profiles",
    f"""WITH {INTENT_SQL} SELECT profile, name AS profile_name, family AS role_family, job_type, yoe AS years_experience, remote_ok,
  array_to_string(roles, '|') AS roles, array_to_string(places, '|') AS places, array_to_string(avoid, '|') AS avoid,
  array_to_string(keywords, '|') AS keywords, array_to_string(industries, '|') AS industries FROM intent""",
)
def _(t: Inputs) -> DataFrame:
    rows = intents.normalize_profiles(t.candidates)
    named = {"target_roles": "roles", "locations": "places", "dealbreakers": "avoid", "raw_keywords": "keywords", "industries": "industries"}
    return rows.select(
        "profile", "profile_name", "role_family", "job_type", "years_experience", "remote_ok",
        *[F.array_join(c, "|").alias(n) for c, n in named.items()],
    )


_PAY = """CASE WHEN trim(lower(coalesce(intern_pay_preference, ''))) IN ('paid_only', 'unpaid_ok', 'no_preference') THEN trim(lower(intern_pay_preference))
  WHEN coalesce(monthly_stipend, 0) <> 0 THEN 'paid_only' ELSE 'no_preference' END"""


@query(
    "structured_profiles",
    f"""SELECT profile, name, CAST(yoe AS BIGINT) AS yoe, CASE WHEN job_type = 'internship' THEN CASE WHEN {_PAY} = 'paid_only' THEN nullif(monthly_stipend, 0) END
    ELSE min_salary END AS target_salary, CASE WHEN job_type = 'internship' THEN {_PAY} END AS pay, CASE WHEN remote_ok THEN 'True' ELSE 'False' END AS remote
FROM v_candidates""",
)
def _(t: Inputs) -> DataFrame:
    rows = intents.structured_profiles(t.candidates)
    return rows.select(
        "profile", "name", F.col("yoe").cast("bigint").alias("yoe"), "target_salary",
        F.col("intern_pay_preference").alias("pay"), F.col("remote_preference").alias("remote"),
    )


_SKILLS8 = f"({dedupe_list_sql('list_concat(domain, tools)')})[1:8]"
_PAY_PART = """CASE WHEN job_type = 'internship' THEN CASE WHEN intern_pay_preference = 'paid_only' THEN CASE WHEN coalesce(monthly_stipend, 0) <> 0
    THEN format('paid internships ${:,}/mo+', monthly_stipend) ELSE 'paid internships only' END END
  WHEN coalesce(min_salary, 0) <> 0 THEN format('compensation ${:,}+', min_salary) END"""
_WHERE_PART = """CASE WHEN remote_ok AND len(places) > 0 THEN concat('remote or ', array_to_string(places[1:2], ', ')) WHEN remote_ok THEN 'remote-friendly'
  WHEN len(places) > 0 THEN array_to_string(places[1:2], ', ') END"""
_AVOID_PART = f"({dedupe_list_sql('list_transform(avoid[1:4], lambda a: replace(a, ' + quoted('required') + ', ' + quoted('') + '))')})"


@query(
    "match_query",
    f"""WITH {INTENT_SQL}, q AS (SELECT *, {_SKILLS8} AS skills, {_AVOID_PART} AS avoided,
  nullif(concat_ws(', ', {_WHERE_PART}, {_PAY_PART}), '') AS wishes FROM intent)
SELECT profile, concat_ws(' ', concat('Candidate seeking ', CASE WHEN job_type = 'internship' THEN 'internship' ELSE 'full-time' END, ' ',
    CASE WHEN len(roles) > 0 THEN array_to_string(roles[1:4], ', ') ELSE 'relevant' END, ' roles.'),
  CASE WHEN yoe <> 0 THEN concat('Experience: ', CAST(yoe AS BIGINT), ' years.') END,
  CASE WHEN len(skills) > 0 THEN concat('Skills: ', array_to_string(skills, ', '), '.') END,
  CASE WHEN len(credentials) > 0 THEN concat('Credentials: ', array_to_string(credentials[1:3], ', '), '.') END,
  CASE WHEN wishes IS NOT NULL THEN concat('Preferences: ', wishes, '.') END,
  CASE WHEN len(avoided) > 0 THEN concat('Avoid: ', array_to_string(avoided[1:4], ', '), '.') END, 'User intent: growth.') AS text FROM q""",
)
def _(t: Inputs) -> DataFrame:
    rows = intents.normalize_profiles(t.candidates)
    return rows.select("profile", intents.match_query(F.lit(" growth ")).alias("text"))


@query(
    "recall_query",
    f"""WITH {INTENT_SQL}, q AS (SELECT *, list_concat(list_concat(list_concat(roles[1:4], (list_concat(domain, tools))[1:8]),
  list_concat(CASE WHEN remote_ok THEN ['remote'] ELSE [] END, places[1:2])), [CASE WHEN job_type = 'internship' THEN 'internship' ELSE 'full-time' END]) AS tokens
  FROM intent) SELECT profile, array_to_string({dedupe_list_sql('tokens')}, ' ') AS text FROM q""",
)
def _(t: Inputs) -> DataFrame:
    return intents.normalize_profiles(t.candidates).select("profile", intents.recall_query().alias("text"))
