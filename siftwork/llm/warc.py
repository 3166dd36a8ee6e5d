"""Not-modified revisits resolved to the full responses they confirm.

A revisit record has no body: it says that the page was still what an earlier crawl got. It is
joined, as of its time, to the latest earlier full response with the same canonical URL; its
validators are checked against that response's, and the headers that a not-modified answer may
update replace the stored ones.

The as-of join has no window over a whole URL, of which one may hold a third of all records: the
records are dealt into ranges of (URL, time), each range finds the responses within itself, and of
each URL only the last response per range is passed on to later ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.shared import stored

# The header fields of a 304 answer that update a stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that only track where a visit came from.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"

RECORDS = "record_id long, warc_type string, uri string, ts long, status int, headers map<string,string>, digest string, length long"


def canonical_url(uri: Column) -> Column:
    """A URL without scheme, ``www.``, default port, fragment, tracking parameters, index page and last slash.

    Host letters are lowered; the path's and the query's are kept. Null stays null.
    """
    url = F.regexp_replace(F.trim(uri), r"#.*$", "")
    url = F.regexp_replace(url, r"^[a-zA-Z]+://", "")
    host = F.lower(F.regexp_extract(url, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(url, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&]){TRACKING}=[^&]*", r"$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&+", "?")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/(index\.html?)?$", "")
    return F.concat(host, rest)


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def _strong(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: what it resolves to and with which headers.

    ``records`` has the columns of ``RECORDS`` (others are not read): ``warc_type`` is ``response`` or
    ``revisit`` (other records are left out), header names are lower case, ``ts`` is in seconds. Only a
    response of status 200 is a full one. Earlier means a smaller ``ts``; of responses at one time the
    largest ``record_id`` counts.

    Columns: ``record_id, canonical, resolution, response_id, response_ts, digest, length, headers``.
    ``resolution`` is ``resolved``; ``mismatch`` where a validator both sides have differs;
    ``unvalidated`` where they have none in common; ``missing`` without an earlier response, a URL or
    a time. Entity tags are compared first (weakly), then modification times, then digests. Only resolved
    rows carry a digest, length and headers. Repeated revisits give repeated rows.
    """
    spark = records.sparkSession
    own = records.select(
        F.col("record_id").cast("long"), "warc_type", canonical_url(F.col("uri")).alias("canonical"), F.col("ts").cast("long"),
        F.col("status").cast("int"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest", F.col("length").cast("long"),
    ).where(F.col("warc_type").isin("response", "revisit"))
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical").isNotNull()
    own = own.where(full | (F.col("warc_type") == "revisit"))
    response = F.when(full, F.struct(F.col("record_id").alias("response_id"), F.col("ts").alias("response_ts"), F.col("headers").alias("stored"), F.col("digest").alias("stored_digest"), F.col("length").alias("stored_length")))
    # A revisit sorts before a response of the same time: that one is not earlier.
    own = own.withColumn("turn", full.cast("int")).withColumn("response", response)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(parts, "canonical", "ts", "turn", "record_id").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "revisits")

    before = Window.partitionBy("part", "canonical").orderBy("ts", "turn", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("here", F.last("response", ignorenulls=True).over(before)).where("warc_type = 'revisit'")
    # One row per range and URL: a URL has at most as many as there are ranges.
    lasts = ranged.groupBy("part", "canonical").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("ts", "record_id"))).alias("own"))
    earlier = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("part", "canonical", F.last("own", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    found = within.join(carried, ["part", "canonical"], "left").withColumn("to", F.when(F.col("ts").isNotNull() & F.col("canonical").isNotNull(), F.coalesce("here", "carried")))

    pairs = [
        (_strong(_header(F.col("headers"), "etag")), _strong(_header(F.col("to.stored"), "etag"))),
        (_header(F.col("headers"), "last-modified"), _header(F.col("to.stored"), "last-modified")),
        (F.col("digest"), F.col("to.stored_digest")),
    ]
    resolution = F.when(F.col("to").isNull(), "missing")
    for mine, theirs in pairs:
        resolution = resolution.when(mine.isNotNull() & theirs.isNotNull(), F.when(mine == theirs, "resolved").otherwise("mismatch"))
    found = found.withColumn("resolution", resolution.otherwise("unvalidated"))
    resolved = F.col("resolution") == "resolved"
    permitted = F.map_filter("headers", lambda name, _: name.isin(PERMITTED))
    kept = F.map_filter("to.stored", lambda name, _: ~F.map_contains_key(permitted, name))
    return found.select(
        "record_id", "canonical", "resolution", F.col("to.response_id").alias("response_id"), F.col("to.response_ts").alias("response_ts"),
        F.when(resolved, F.col("to.stored_digest")).alias("digest"), F.when(resolved, F.col("to.stored_length")).alias("length"),
        F.when(resolved, F.map_concat(kept, permitted)).alias("headers"),
    )
