"""Streaming twins of the batch load: ingest, dedupe, funnel and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwork import vocab
from siftwork.plans.ingest import POSTING_KEYS, POSTING_PARTITIONS, POSTINGS, ingest
from siftwork.sources.statuses import BUCKETS, append_changes, compact_statuses
from siftwork.sources.tables import append_new, delete_from_table, read_table, upsert_table

RAW = "profile string, source string, company string, fetched_at timestamp, payload string"
# The parts of threads that are kept for later batches: what they are, when they came, a digest of their content.
THREADS = RAW + ", digest string, kind string, day date"
THREAD_KEYS = ["profile", "digest"]
THREAD_PARTITIONS = ["profile", "kind", "day"]


def read_landing(spark: SparkSession, path: str, schema: str = RAW, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def _kind() -> Column:
    spans = F.get_json_object("payload", "$.hits").isNotNull() | F.get_json_object("payload", "$.kids").isNotNull()
    return F.when(spans, "list").otherwise("comment")


def thread_parts(batch: DataFrame, as_of: Column) -> DataFrame:
    """The batch's thread payloads as they are kept: search results and threads are lists, all else is a comment."""
    rows = batch.where(F.col("source") == "hackernews").withColumn("kind", _kind()).withColumn("digest", F.sha2("payload", 256))
    day = F.to_date(F.coalesce("fetched_at", as_of))
    return rows.withColumn("day", day).select(*[f.split()[0] for f in THREADS.split(", ")])


def young_parts(as_of: Column, max_age_days: int) -> Column:
    """Is a kept part young enough to matter? A thread counts for ``max_age_days``, and its parts come after it."""
    return F.col("day") >= F.date_sub(F.to_date(as_of), max_age_days + 1)


def with_earlier_threads(batch: DataFrame, threads: DataFrame) -> DataFrame:
    """The batch, and of ``threads`` the payloads that its thread payloads belong together with.

    New comments meet the kept search results and threads of their profile; a new search result
    or thread meets the kept comments too. Payloads of the batch itself are not taken twice.
    """
    own = batch.where(F.col("source") == "hackernews").select("profile", _kind().alias("_kind"), F.sha2("payload", 256).alias("digest"))
    touched = own.groupBy("profile").agg(F.max(F.col("_kind") == "list").alias("_lists"))
    earlier = threads.join(touched, "profile").where(F.col("_lists") | (F.col("kind") == "list"))
    earlier = earlier.join(own.select(*THREAD_KEYS).distinct(), THREAD_KEYS, "left_anti")
    return batch.unionByName(earlier.select(*batch.columns))


def start_ingest(
    landing: DataFrame, profiles: DataFrame, table: str, checkpoint: str, as_of: Column, max_age_days: int = vocab.THREAD_MAX_AGE_DAYS
) -> StreamingQuery:
    """Landed payloads into the posting table, insert-only; runs until nothing new has landed.

    Each micro-batch takes the batch plan unchanged. A thread comes as several payloads, which may
    land in any order and in any batches: they are kept in a table beside the postings, once each, and join
    the later batches. What is older than a thread may be is removed, so the table is bounded by what lands in that time.
    A batch that is repeated after a failure finds its postings and its parts of threads stored and adds nothing.
    """
    kept = f"{table.rstrip('/')}-threads"

    def load(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        threads = read_table(spark, kept, THREADS)
        rows = with_earlier_threads(batch, threads.where(young_parts(as_of, max_age_days)))
        append_new(ingest(rows, profiles, as_of, max_age_days=max_age_days), table, POSTINGS, POSTING_KEYS, POSTING_PARTITIONS, "created_at")
        append_new(thread_parts(batch, as_of), kept, THREADS, THREAD_KEYS, THREAD_PARTITIONS, "fetched_at")
        delete_from_table(spark, kept, THREADS, ~young_parts(as_of, max_age_days), THREAD_PARTITIONS)

    return (
        landing.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedupe_stream(rows: DataFrame, keys: list[str] = POSTING_KEYS, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First row per posting within the watermark; the insert-only load covers what is later.

    A posting's key is its profile, source and id: other tenants may hold the same id.
    """
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def funnel_by_hour(rows: DataFrame, ts: str = "ts", late: str | None = "2 hours") -> DataFrame:
    """Rows per hour, source and stage. With ``late``, a stream drops rows behind the watermark."""
    timed = rows.withWatermark(ts, late) if late is not None else rows
    counted = timed.groupBy(F.window(ts, "1 hour").alias("w"), "source", "stage").agg(F.count("*").alias("postings"))
    return counted.select(F.col("w.start").alias("hour"), "source", "stage", "postings")


def current_status(changes: DataFrame) -> DataFrame:
    """The last status per posting; combined before the shuffle."""
    last = F.max_by("new_status", F.struct("changed_at", "change_id"))
    return changes.groupBy("profile", "id").agg(last.alias("status"), F.max("changed_at").alias("changed_at"))


STATUS = "id string, status string, changed_at timestamp, profile string"


def start_status(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Status changes into a table of current statuses; an older change never overwrites a newer one."""
    def load(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = current_status(batch)
        held = read_table(spark, table, STATUS).select(
            "profile", "id", F.col("changed_at").alias("_held")
        )
        newer = fresh.join(held, ["profile", "id"], "left").where(
            F.col("_held").isNull() | (F.col("changed_at") >= F.col("_held"))
        )
        columns = [f.split()[0] for f in STATUS.split(", ")]
        upsert_table(newer.select(*columns), table, STATUS, ["profile", "id"], ["profile"])

    return (
        changes.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_status_log(changes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, fold_at: int = 8) -> StreamingQuery:
    """Status changes into a bucketed log: a micro-batch adds files to the buckets of its postings and rewrites none.

    Buckets with ``fold_at`` batches are folded on the way. ``sources.statuses.current_statuses`` reads the log.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        append_changes(batch, path, batch_id, buckets)
        compact_statuses(batch.sparkSession, path, fold_at)

    return (
        changes.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
