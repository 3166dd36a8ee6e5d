"""Text scalars over whole tables."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.catalog.core import Inputs, query, quoted, sql_list, trimmed
from siftwork.functions import text as X
from siftwork.functions.html import strip_html, unescape
from siftwork.functions.strings import dedupe_exact, dedupe_ignoring_case, string_array

_ENTITIES = [("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")]


def _unescape_sql(expr: str) -> str:
    for name, char in _ENTITIES:
        expr = f"replace({expr}, '&{name};', {quoted(char)})"
    return expr


_STRIP_SQL = f"""
WITH a AS (SELECT page_id, {_unescape_sql('html')} AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'),
  '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, {_unescape_sql('t')} AS t FROM b),
d AS (SELECT page_id, array_to_string(list_filter(list_transform(
  flatten(list_transform(string_split(t, chr(10)), lambda l: string_split(trim(l, e' \\t\\r '), '  '))),
  lambda p: trim(p, e' \\t\\r ')), lambda p: p <> ''), chr(10)) AS t FROM c)
SELECT page_id, {_unescape_sql('t')} AS body FROM d
"""


@query("strip_html", _STRIP_SQL)
def _(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", strip_html(F.col("html")).alias("body"))


_BLOCK_TAGS = "address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul"


@query(
    "strip_html_paragraphs",
    f"""
WITH a AS (SELECT page_id, {_unescape_sql('html')} AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t,
  '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'),
  '(?s)<!--.*?-->|<![^>]*>', '', 'g') AS t FROM a),
m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)</?({_BLOCK_TAGS})([\\s/][^>]*)?>', chr(2), 'g'),
  '(?i)</?(br|li)([\\s/][^>]*)?>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS t FROM b),
c AS (SELECT page_id, i, {_unescape_sql('part')} AS t FROM (SELECT page_id, unnest(string_split(t, chr(2))) AS part, generate_subscripts(string_split(t, chr(2)), 1) AS i FROM m)),
d AS (SELECT page_id, i, array_to_string(list_filter(list_transform(
  flatten(list_transform(string_split(t, chr(10)), lambda l: string_split(trim(l, e' \\t\\r '), '  '))),
  lambda p: trim(p, e' \\t\\r ')), lambda p: p <> ''), chr(10)) AS t FROM c)
SELECT page_id, coalesce(string_agg({_unescape_sql('t')}, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '') AS body FROM d GROUP BY page_id
""",
)
def _(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", strip_html(F.col("html"), keep_paragraphs=True).alias("body"))


# Names of the standard that stand for something to see, one per page in turn.
_SEEN = sorted(n for n, c in html5.items() if not any(x.isspace() for x in c))


@query(
    "strip_html_rare_entities",
    f"""SELECT page_id, CASE WHEN body = '' THEN '' ELSE body || chr(10) END || ({sql_list(html5[n] for n in _SEEN)})[1 + page_id % {len(_SEEN)}] || ' end' AS body
FROM ({_STRIP_SQL}) s""",
)
def _(t: Inputs) -> DataFrame:
    """The whole page with one more paragraph, which holds an entity."""
    name = F.get(string_array(_SEEN), (F.col("page_id") % len(_SEEN)).cast("int"))
    return t.pages.select("page_id", strip_html(F.concat("html", F.lit("\n<p>&"), name, F.lit(" end</p>"))).alias("body"))


# All names of the standard, one per page in turn.
_NAMES = sorted(html5)


@query(
    "strip_html_all_entities",
    f"""SELECT page_id, concat('<', page_id, ' ', ({sql_list(html5[n] for n in _NAMES)})[1 + page_id % {len(_NAMES)}], ' &', url) AS body
FROM pages""",
)
def _(t: Inputs) -> DataFrame:
    names = F.array(*[F.lit(f"&{n}") for n in _NAMES])
    name = F.get(names, (F.col("page_id") % len(_NAMES)).cast("int"))
    text = F.concat(F.lit("&lt;"), F.col("page_id"), F.lit(" "), name, F.lit(" &"), F.replace("url", F.lit("&"), F.lit("&amp;")))
    return t.pages.select("page_id", unescape(text).alias("body"))


@query("make_id", "SELECT doc_id, concat(source, '_', doc_id) AS id FROM documents")
def _(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", X.make_id(F.col("source"), F.col("doc_id")).alias("id"))


def _priority_sql(expr: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({expr}), {quoted(p)}) THEN {i}" for i, p in enumerate(vocab.PARAGRAPH_PATTERNS)
    )
    return f"(CASE {whens} ELSE {len(vocab.PARAGRAPH_PATTERNS)} END)"


@query(
    "paragraph_priority",
    f"SELECT id, CAST({_priority_sql('body')} AS BIGINT) AS priority, "
    f"CAST({_priority_sql('title')} AS BIGINT) AS title_priority FROM v_postings",
)
def _(t: Inputs) -> DataFrame:
    return t.postings.select(
        "id",
        X.paragraph_priority(F.col("body")).cast("bigint").alias("priority"),
        X.paragraph_priority(F.col("title")).cast("bigint").alias("title_priority"),
    )


@query(
    "build_raw_text",
    f"""
WITH a AS (SELECT id, concat('Title: ', title, chr(10), 'Company: ', company, chr(10), 'Location: ', location, chr(10),
      'URL: ', url) AS h, {trimmed("concat('Description:', chr(10), text)")} AS d FROM v_postings),
b AS (SELECT id, concat(h, chr(10), chr(10), d) AS whole, h, d, {_priority_sql('h')} AS ph, {_priority_sql('d')} AS pd,
      length(h) AS lh, length(d) AS ld FROM a),
c AS (SELECT *, CASE
    WHEN ph <= pd THEN CASE WHEN lh + 1 + ld + 1 <= 2000 THEN 'both' WHEN pd <= 2 AND lh + 1 < 1800 THEN 'h+cut' ELSE 'h' END
    WHEN ld + 1 <= 2000 THEN CASE WHEN ld + 1 + lh + 1 <= 2000 THEN 'both' WHEN ph <= 2 AND ld + 1 < 1800 THEN 'cut+d' ELSE 'd' END
    WHEN pd <= 2 THEN 'cut' ELSE 'h' END AS kept FROM b)
SELECT id, CASE WHEN length(whole) <= 2000 THEN whole
  WHEN kept = 'both' THEN whole WHEN kept = 'h' THEN h WHEN kept = 'd' THEN d
  WHEN kept = 'h+cut' THEN concat(h, chr(10), chr(10), substr(d, 1, 2000 - lh - 1 - 4), '...')
  WHEN kept = 'cut+d' THEN concat(substr(h, 1, 2000 - ld - 1 - 4), '...', chr(10), chr(10), d)
  ELSE concat(substr(d, 1, 1996), '...') END AS raw FROM c
""",
)
def _(t: Inputs) -> DataFrame:
    c = F.col
    return t.postings.select(
        "id", X.build_raw_text(c("title"), c("company"), c("location"), c("url"), c("text")).alias("raw")
    )


@query("extract_job_context")
def _(t: Inputs) -> DataFrame:
    return t.postings.select("id", X.extract_job_context(F.col("raw_text"), 2000).alias("context"))


@query(
    "parse_posted_at",
    """
WITH s AS (SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events)
SELECT event_id, CASE event_id % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 3 THEN us + 18000000000 ELSE us END AS posted_us
FROM s
""",
)
def _(t: Inputs) -> DataFrame:
    s = t.events.select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    seconds = F.unix_timestamp("ts").cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 7
    spelled = (
        F.when(k == 0, seconds).when(k == 1, F.concat(seconds, F.lit("000"))).when(k == 2, F.concat(iso, F.lit("Z")))
        .when(k == 3, F.concat(iso, F.lit("-05:00"))).when(k == 4, F.concat(F.lit(" "), iso))
        .when(k == 5, F.lit("next week")).otherwise("")
    )
    return s.select("event_id", F.unix_micros(X.parse_posted_at(spelled)).alias("posted_us"))


_YOE_SQL = "(?i)(?:" + "|".join(vocab.YOE_PATTERNS) + ")"
YOE_LIST_SQL = (
    f"list_transform(regexp_extract_all(raw_text, {quoted(_YOE_SQL)}), lambda m: "
    "list_max(list_transform(regexp_extract_all(m, '[0-9]+'), lambda n: CAST(n AS BIGINT))))"
)


@query("extract_yoe", f"SELECT id, array_to_string({YOE_LIST_SQL}, ',') AS years FROM v_postings")
def _(t: Inputs) -> DataFrame:
    years = X.extract_yoe(F.col("raw_text")).cast("array<string>")
    return t.postings.select("id", F.array_join(years, ",").alias("years"))


@query(
    "normalize_title",
    "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM documents",
)
def _(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_title(F.col("text")).alias("normalized"))


@query(
    "sanitize_slug",
    f"SELECT doc_id, regexp_replace(replace({trimmed('lower(text)')}, ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS slug "
    "FROM documents",
)
def _(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", X.sanitize_slug(F.col("text")).alias("slug"))


@query(
    "company_slug",
    f"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(lower({trimmed('text')}), ' ', '-'), '.', ''),
  '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM documents""",
)
def _(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", X.company_slug(F.col("text")).alias("slug"))


def _slug_sql() -> str:
    parts = ["lower(split_part(domain, '.', 1))"]
    parts += [f"replace(clean, ' ', '{j}')" for j in ("", "-", "_")]
    for suffix in vocab.SLUG_SUFFIXES:
        short = f"trim(replace(clean, '{suffix}', ''))"
        parts += [f"CASE WHEN {short} <> clean THEN replace({short}, ' ', '{j}') ELSE '' END" for j in ("", "-")]
    return f"""
WITH n AS (SELECT c_custkey, trim(regexp_replace(lower(concat(c_name, CASE c_custkey % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Company'
    WHEN 2 THEN ' co-op LLC' ELSE '' END)), '[^a-z0-9_ -]', '', 'g')) AS clean,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(lower(c_mktsegment), '.example.com') END AS domain FROM customer),
g AS (SELECT c_custkey, unnest([{", ".join(parts)}]) AS guess, unnest(range({len(parts)})) AS pos FROM n),
f AS (SELECT c_custkey, guess, min(pos) AS pos FROM g WHERE guess <> '' GROUP BY ALL)
SELECT c_custkey, string_agg(guess, '|' ORDER BY pos) AS guesses FROM f GROUP BY c_custkey
"""


@query("slug_candidates", _slug_sql())
def _(t: Inputs) -> DataFrame:
    k = F.col("c_custkey") % 4
    tail = F.when(k == 0, " Inc").when(k == 1, " Company").when(k == 2, " co-op LLC").otherwise("")
    domain = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit(".example.com"))
    )
    return t.customer.select(
        "c_custkey", F.array_join(X.slug_candidates(F.concat("c_name", tail), domain), "|").alias("guesses")
    )


@query(
    "chunk_uid",
    """SELECT vec_id, 'hash_64_v1' AS slug, concat(job_id, ':', chunk_key, ':', 'hash_64_v1') AS uid FROM v_chunks""",
)
def _(t: Inputs) -> DataFrame:
    c = F.col
    return t.chunks.select(
        "vec_id", X.model_slug(c("model_name")).alias("slug"),
        X.chunk_uid(c("job_id"), c("chunk_key"), c("model_name")).alias("uid"),
    )


def _field_sql(label: str) -> str:
    value = trimmed("regexp_extract(raw_text, '(?m)^" + label + ":\\s*(.+)$', 1)")
    return f"nullif({value}, '')"


@query(
    "extract_metadata",
    "SELECT id, " + ", ".join(f"{_field_sql(label)} AS {label.lower()}" for label in ("Title", "Company", "Location", "URL"))
    + " FROM v_postings",
)
def _(t: Inputs) -> DataFrame:
    raw = F.col("raw_text")
    return t.postings.select(
        "id", *[X.metadata_field(raw, label).alias(label.lower()) for label in ("Title", "Company", "Location", "URL")]
    )


@query(
    "description_body",
    f"SELECT id, {trimmed('substr(raw_text, strpos(raw_text, m) + length(m))')} AS description "
    "FROM (SELECT *, concat(chr(10), 'Description:', chr(10)) AS m FROM v_postings) x",
)
def _(t: Inputs) -> DataFrame:
    return t.postings.select("id", X.description_body(F.col("raw_text")).alias("description"))


def _dedupe_sql(key: str) -> str:
    return f"""
WITH w AS (SELECT conv_id, turn, trim(unnest(string_split(text, ' '))) AS word,
    unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations),
f AS (SELECT conv_id, turn, {key} AS k, min(pos) AS pos FROM w WHERE word <> '' GROUP BY ALL)
SELECT f.conv_id, f.turn, string_agg(w.word, ' ' ORDER BY f.pos) AS words
FROM f JOIN w ON w.conv_id = f.conv_id AND w.turn = f.turn AND w.pos = f.pos GROUP BY f.conv_id, f.turn
"""


@query("dedupe_preserve_order", _dedupe_sql("lower(word)"))
def _(t: Inputs) -> DataFrame:
    words = F.split("text", " ")
    return t.conversations.select("conv_id", "turn", F.array_join(dedupe_ignoring_case(words), " ").alias("words"))


@query("dedupe_exact", _dedupe_sql("word"))
def _(t: Inputs) -> DataFrame:
    words = F.split("text", " ")
    return t.conversations.select("conv_id", "turn", F.array_join(dedupe_exact(words), " ").alias("words"))


@query(
    "parse_money",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS amount FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    whole = F.floor("o_totalprice")
    k = F.col("o_orderkey") % 5
    spelled = (
        F.when(k == 0, F.concat(F.lit("$"), F.format_number(whole, 0)))
        .when(k == 1, F.format_number(whole, 0))
        .when(k == 2, whole.cast("string"))
        .when(k == 3, F.concat(F.lit(" $ "), whole.cast("string"), F.lit(" ")))
        .otherwise(F.concat(whole.cast("string"), F.lit("k")))
    )
    return t.orders.select("o_orderkey", X.parse_money(spelled).alias("amount"))


_TERMS = ["license", "und ", "that"]


@query(
    "snippet",
    f"""
WITH a AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {trimmed('l')}),
    lambda l: l <> ''), ' ') AS t FROM documents),
b AS (SELECT doc_id, t, list_filter({sql_list(_TERMS)}, lambda w: contains(lower(t), w)) AS hits FROM a),
c AS (SELECT doc_id, t, hits, strpos(lower(t), hits[1]) - 1 AS p0 FROM b),
d AS (SELECT *, greatest(0, p0 - 45) AS s, least(length(t), p0 + 115) AS e FROM c)
SELECT doc_id, CASE WHEN len(hits) = 0 THEN CASE WHEN length(t) > 160 THEN concat({trimmed('substr(t, 1, 160)')}, '...')
    ELSE {trimmed('substr(t, 1, 160)')} END
  WHEN s > 0 OR e < length(t) THEN concat('...', {trimmed('substr(t, s + 1, e - s)')}, '...')
  ELSE {trimmed('substr(t, s + 1, e - s)')} END AS snippet FROM d
""",
)
def _(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", X.snippet(F.col("text"), string_array(_TERMS)).alias("snippet"))


@query(
    "prepare_chunk_text",
    f"""
WITH a AS (SELECT id, {trimmed('raw_text')} AS t, list_filter(list_transform(string_split(raw_text, chr(10)), lambda l: {trimmed('l')}),
    lambda l: l <> '') AS lines FROM v_postings),
b AS (SELECT id, t, lines, list_filter(lines[1:4], lambda l: contains(l, ':')) AS heads FROM a),
c AS (SELECT id, t, array_to_string(heads, chr(10)) AS h,
    array_to_string(list_filter(lines, lambda l: NOT list_contains(heads, l)), ' ') AS body FROM b)
SELECT id, CASE WHEN length(t) <= 900 THEN t ELSE {trimmed(
    "concat(h, chr(10), trim(regexp_replace(substr(body, 1, 900 - least(length(h), 300) - 1), ' [^ ]*$', '')))")} END AS prepared
FROM c
""",
)
def _(t: Inputs) -> DataFrame:
    return t.postings.select("id", X.prepare_chunk_text(F.col("raw_text"), 900).alias("prepared"))


@query(
    "query_terms",
    f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#./-]{{2,}}'),
  lambda w: NOT list_contains({sql_list(vocab.QUERY_STOPWORDS)}, lower(w))), ' ') AS terms FROM documents""",
)
def _(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@query(
    "summarize_errors",
    """
WITH e AS (SELECT run_id, CASE WHEN no_errors THEN [] ELSE errors END AS errors, trim(errors[1]) AS f FROM v_runs)
SELECT run_id, CASE WHEN len(errors) = 0 THEN 'None' ELSE concat(
  CASE WHEN length(f) > 72 THEN concat(rtrim(substr(f, 1, 71)), '…') ELSE f END,
  CASE WHEN len(errors) > 1 THEN concat(' (+', len(errors) - 1, ' more)') ELSE '' END) END AS summary FROM e
""",
)
def _(t: Inputs) -> DataFrame:
    errors = F.when(F.col("no_errors"), F.array().cast("array<string>")).otherwise(F.col("errors"))
    return t.runs.select("run_id", X.summarize_errors(errors, 72).alias("summary"))


@query(
    "score_state",
    """
SELECT id, CASE WHEN fit_score IS NOT NULL THEN 'Scored' WHEN score_attempts >= 3 THEN 'Failed'
  WHEN coalesce(score_error, '') <> '' THEN 'Needs retry' ELSE 'Pending' END AS state
FROM v_postings p LEFT JOIN v_scores s ON s.profile = p.profile AND s.job_id = p.id
""",
)
def _(t: Inputs) -> DataFrame:
    scores = t.scores.select("profile", F.col("job_id").alias("id"), "fit_score")
    joined = t.postings.select("profile", "id", "score_attempts", "score_error").join(scores, ["profile", "id"], "left")
    return joined.select(
        "id", X.score_state(F.col("fit_score"), F.col("score_attempts"), F.col("score_error")).alias("state")
    )


@query(
    "labels_of_source_and_status",
    f"""
SELECT doc_id, CASE source {' '.join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in vocab.SOURCE_LABELS.items())} END AS source_label,
  concat(upper(status[1]), substr(status, 2)) AS status_label, concat('Own Board ', upper(company[1]), substr(company, 2)) AS other_label
FROM v_postings
""",
)
def _(t: Inputs) -> DataFrame:
    c = F.col
    return t.postings.select(
        "doc_id", X.source_label(c("source")).alias("source_label"), X.status_label(c("status")).alias("status_label"),
        X.source_label(F.concat(F.lit("own_board_"), c("company"))).alias("other_label"),
    )


@query(
    "disqualified_signal",
    """
WITH f AS (SELECT job_id, disqualified, disqualify_reason,
  list_filter(flags, lambda f: starts_with(f, 'disqualified:'))[1] AS flag FROM v_scores)
SELECT job_id, disqualified OR (disqualify_reason = '' AND flag IS NOT NULL) AS disqualified,
  CASE WHEN NOT disqualified AND disqualify_reason = '' AND flag IS NOT NULL THEN trim(substr(flag, 14)) ELSE disqualify_reason END AS reason
FROM f
""",
)
def _(t: Inputs) -> DataFrame:
    out, why = X.disqualified_signal(F.col("disqualified"), F.col("disqualify_reason"), F.col("flags"))
    return t.scores.select("job_id", out.alias("disqualified"), why.alias("reason"))


@query(
    "match_band",
    """SELECT job_id, CASE WHEN fit_score >= 85 THEN 'excellent' WHEN fit_score >= 70 THEN 'strong' WHEN fit_score >= 55 THEN 'fair'
  ELSE 'weak' END AS band FROM v_scores""",
)
def _(t: Inputs) -> DataFrame:
    return t.scores.select("job_id", X.match_band(F.col("fit_score")).alias("band"))
