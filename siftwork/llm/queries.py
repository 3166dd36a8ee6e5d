"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), width=2)


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.shared import new_folder
    from siftwork.llm.token_files import digests, read_files, write_files

    files = new_folder(spark, "tokens")
    write_files(table(spark, folder, "documents"), BPE, files)
    return digests(read_files(spark, files))


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.quality import quality_scores

    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.sketches import fingerprints

    return fingerprints(table(spark, folder, "documents"))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.packing import pack

    return pack(table(spark, folder, "documents"), BPE).drop("ids")


@query
def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.substrings import removal_digests

    return removal_digests(table(spark, folder, "documents"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.templates import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Every page as the response of a crawl, and a revisit of a variant of its URL 25 hours later.

    What the revisit sends as validators (a weak, a stale or no entity tag, a time, a digest, nothing)
    follows from the length of the page.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html")), 1, 12), F.lit('"'))
    modified = (F.col("page_id") * 60 - 3600).cast("string")
    full = F.map_from_arrays(
        F.array(*map(F.lit, ["cache-control", "content-length", "content-type", "date", "etag", "last-modified"])),
        F.array(F.lit("max-age=60"), size.cast("string"), F.lit("text/html"), (F.col("page_id") * 60).cast("string"), tag, modified),
    )
    bare = size % 11 == 0
    sent = F.when(bare | (size % 5 == 0), F.lit(None)).when(size % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    again = F.map_from_arrays(
        F.array(*map(F.lit, ["cache-control", "content-type", "date", "etag", "last-modified"])),
        F.array(F.lit("max-age=120"), F.lit("text/plain"), (F.col("page_id") * 60 + 90000).cast("string"), sent, F.when(bare, F.lit(None)).otherwise(modified)),
    )
    again = F.map_filter(again, lambda _, v: v.isNotNull())
    digest = F.md5(F.col("html"))
    responses = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("uri"), (F.col("page_id") * 60).alias("ts"), F.when(F.col("html").isNull(), 404).otherwise(200).alias("status"), full.alias("headers"), digest.alias("digest"), size.alias("length"))
    uri = F.concat(F.regexp_replace("url", "^https?://(www[.])?", "HTTPS://WWW."), F.when(F.col("url").contains("#"), F.lit("")).otherwise(F.lit("#seen")))
    revisits = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), uri.alias("uri"), (F.col("page_id") * 60 + 90000).alias("ts"), F.lit(304).alias("status"), again.alias("headers"), F.when(~bare, digest).alias("digest"), F.lit(0).cast("long").alias("length"))
    return responses.unionByName(revisits)


@query
def op8_revisits(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.warc import resolve

    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolve(crawl_records(table(spark, folder, "pages"))).withColumn("headers", F.array_join(lines, "\n"))


def _canonical_sql(uri: str) -> str:
    url = f"regexp_replace(regexp_replace(trim({uri}), '#.*$', ''), '^[a-zA-Z]+://', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({url}, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '')"
    rest = f"regexp_replace({url}, '^[^/?]*', '')"
    rest = rf"regexp_replace({rest}, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g')"
    rest = rf"regexp_replace(regexp_replace({rest}, '&&+', '&', 'g'), '\?&+', '?', 'g')"
    rest = rf"regexp_replace(regexp_replace({rest}, '[?&]+$', ''), '/(index\.html?)?$', '')"
    return f"({host} || {rest})"


ORACLES["op8_revisits"] = f"""
WITH p AS (
    SELECT page_id, url, md5(html) AS digest, coalesce(strlen(html), 0) AS n, html IS NULL AS gone, '"' || substr(md5(html), 1, 12) || '"' AS tag, CAST(page_id * 60 - 3600 AS VARCHAR) AS modified FROM pages
), full_responses AS (
    SELECT page_id * 2 AS response_id, {_canonical_sql("url")} AS canonical, page_id * 60 AS response_ts, n, digest, tag, modified FROM p WHERE NOT gone
), revisits AS (
    SELECT page_id * 2 + 1 AS record_id, {_canonical_sql("regexp_replace(url, '^https?://(www[.])?', 'HTTPS://WWW.') || CASE WHEN contains(url, '#') THEN '' ELSE '#seen' END")} AS canonical,
        page_id * 60 + 90000 AS ts,
        CASE WHEN n % 11 = 0 OR n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN '"stale"' ELSE 'W/' || tag END AS tag,
        CASE WHEN n % 11 <> 0 THEN modified END AS modified, CASE WHEN n % 11 <> 0 THEN digest END AS digest
    FROM p
), paired AS (
    SELECT r.record_id, r.canonical, r.ts, r.tag AS sent, r.modified AS sent_modified, s.response_id, s.response_ts, s.n, s.digest, s.tag, s.modified,
        CASE WHEN s.response_id IS NULL THEN 'missing'
            WHEN r.tag IS NOT NULL AND s.tag IS NOT NULL THEN CASE WHEN regexp_replace(r.tag, '^W/', '') = s.tag THEN 'resolved' ELSE 'mismatch' END
            WHEN r.modified IS NOT NULL AND s.modified IS NOT NULL THEN CASE WHEN r.modified = s.modified THEN 'resolved' ELSE 'mismatch' END
            WHEN r.digest IS NOT NULL AND s.digest IS NOT NULL THEN CASE WHEN r.digest = s.digest THEN 'resolved' ELSE 'mismatch' END
            ELSE 'unvalidated' END AS resolution
    FROM revisits r ASOF LEFT JOIN full_responses s ON r.canonical = s.canonical AND r.ts > s.response_ts
)
SELECT record_id, canonical, resolution, response_id, response_ts, CASE WHEN resolution = 'resolved' THEN digest END AS digest, CASE WHEN resolution = 'resolved' THEN n END AS length,
    CASE WHEN resolution = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
        || 'etag: ' || coalesce(sent, tag) || chr(10) || 'last-modified: ' || coalesce(sent_modified, modified) END AS headers
FROM paired
"""


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), BPE)


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.lexical import search

    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS_SQL = rf"regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_ranked_search"] = f"""
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, {_TERMS_SQL} AS terms FROM documents
), lengths AS (
    SELECT row_no, doc_id, len(terms) AS n FROM texts WHERE len(terms) > 0
), corpus AS (
    SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM lengths
), occurrences AS (
    SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM texts) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM occurrences, corpus GROUP BY term, documents
), asked AS (
    SELECT item_no, item_id, term, count(*) AS times
    FROM (SELECT item_no, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item_no, item_id, {_TERMS_SQL} AS terms FROM benchmark)) GROUP BY ALL
), scored AS (
    SELECT item_no, item_id, row_no, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN occurrences USING (term) JOIN lengths USING (row_no), corpus GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


@query
def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.pieces import round_trip

    rows = round_trip(table(spark, folder, "documents"), PIECE_BPE)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.get("starts", F.lit(0)), F.lit(0)).cast("long").alias("source_bytes"),
    )


@query
def op12_conversation_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    from siftwork.llm.prefix_trie import conversation_prefixes

    return conversation_prefixes(table(spark, folder, "conversations"))


_CRC_STEP = "CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END"
_CRC_SQL = f"xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, x: {_CRC_STEP}), 4294967295)"

ORACLES["op12_conversation_prefixes"] = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS symbol
    FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT conv_id, symbol, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, symbol) AS place FROM turns
), convs AS (
    SELECT conv_id, {_CRC_SQL} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), pieces AS (
    SELECT c.conv_id, 0 AS own, p.place, p.symbol, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 20 AND p.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1, p.place, p.symbol, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h
), steps AS (
    SELECT conv_id, words, row_number() OVER w AS depth, string_agg(symbol, '') OVER (w ROWS UNBOUNDED PRECEDING) AS key FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
), prefixes AS (
    SELECT conv_id, 0 AS depth, '' AS key, NULL AS parent_key, 0 AS words FROM convs
    UNION ALL
    SELECT conv_id, depth, key, substr(key, 1, len(key) - 32), words FROM steps
), nodes AS (
    SELECT key, any_value(parent_key) AS parent_key, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY key
), children AS (
    SELECT parent_key AS key, count(*) AS n_children FROM nodes WHERE parent_key IS NOT NULL GROUP BY parent_key
), under AS (
    SELECT a.key, sum(CASE WHEN c.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
    FROM (SELECT DISTINCT a.key, b.key AS inner_key FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.depth <= b.depth) a
    JOIN nodes n ON n.key = a.inner_key LEFT JOIN children c ON c.key = a.inner_key GROUP BY a.key
), ends AS (
    SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, max_by(key, depth) AS key FROM prefixes GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
    CAST(u.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent_key LEFT JOIN children c ON c.key = n.key JOIN under u ON u.key = n.key LEFT JOIN ends e ON e.key = n.key
"""
