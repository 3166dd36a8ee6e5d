import json
import pathlib

import pytest

from pyspark.sql import functions as F

from siftwork.operators.usage import rolling_usage
from siftwork.plans.embedding import CHUNKS, embed_pending
from siftwork.plans.ingest import POSTINGS, ingest
from siftwork.sources.tables import read_table
from siftwork.streaming import ingest as S
from tests.test_sources import all_payloads, raw_rows


def landed(spark, path, *rows):
    raw_rows(spark, *rows).write.mode("append").json(path)


def profiles(profile_rows):
    on = F.struct(*[F.lit(True).alias(s) for s in ("greenhouse", "lever", "hn", "ashby", "workable", "himalayas")])
    return profile_rows().withColumn("sources_enabled", on)


def test_stream_equals_batch_and_repeats_nothing(spark, profile_rows, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    as_of = F.lit("2025-01-31").cast("timestamp")
    p = profiles(profile_rows)
    landed(spark, landing, *all_payloads())
    for _ in range(2):
        S.start_ingest(S.read_landing(spark, landing), p, table, state, as_of).awaitTermination()
    stored = {(r["id"], r["scrape_filter_reason"]) for r in read_table(spark, table, POSTINGS).collect()}
    batch = {(r["id"], r["scrape_filter_reason"]) for r in ingest(raw_rows(spark, *all_payloads()), p, as_of).collect()}
    assert stored == batch
    # The same payloads landing again add nothing, a new posting is added.
    new = {"jobs": [{"id": "N1", "title": "Engineer", "location": "Remote", "descriptionPlain": "x"}]}
    landed(spark, landing, *all_payloads(), ("ashby", "cosy", new))
    S.start_ingest(S.read_landing(spark, landing), p, table, state, as_of).awaitTermination()
    ids = [r["id"] for r in read_table(spark, table, POSTINGS).collect()]
    assert sorted(ids) == sorted({i for i, _ in stored} | {"ashby_N1"})


def test_dedupe_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "id string, ts timestamp, source string, stage string, profile string"

    def land(*rows):
        df = spark.createDataFrame([json.dumps(dict(zip(("id", "ts", "source", "stage", "profile"), (*r, "p")[:5]))) for r in rows], "string")
        df.coalesce(1).write.mode("append").text(path)

    def run(build, name):
        q = build(spark.readStream.schema(schema).json(path)).writeStream.format("memory").queryName(name)
        q = q.option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        return q

    land(("a", "2025-01-01T00:15:00Z", "lever", "other", "q"))
    land(("a", "2025-01-01T00:10:00Z", "lever", "saved"), ("a", "2025-01-01T00:20:00Z", "lever", "saved"), ("b", "2025-01-01T00:30:00Z", "lever", "saved"))
    dedupe, funnel = run(S.dedupe_stream, "deduped"), run(S.funnel_by_hour, "funnel")
    try:
        for q in (dedupe, funnel):
            q.processAllAvailable()
        land(("c", "2025-01-01T09:00:00Z", "lever", "saved"))
        for q in (dedupe, funnel):
            q.processAllAvailable()
        land(("d", "2025-01-01T00:40:00Z", "lever", "saved"), ("e", "2025-01-01T20:00:00Z", "lever", "saved"))
        for q in (dedupe, funnel):
            q.processAllAvailable()
    finally:
        dedupe.stop()
        funnel.stop()
    # One row per tenant, though both hold the same id.
    assert sorted(r["profile"] for r in spark.table("deduped").where("id = 'a'").collect()) == ["p", "q"]
    hours = {r["hour"].isoformat(): r["postings"] for r in spark.table("funnel").collect()}
    assert hours["2025-01-01T00:00:00"] == 3  # the row that came behind the watermark is dropped


def test_status_stream_keeps_the_newest(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    schema = "profile string, id string, new_status string, changed_at timestamp, change_id bigint"

    def step(*rows):
        df = spark.createDataFrame(list(rows), "profile string, id string, new_status string, t string, change_id bigint")
        df.select("profile", "id", "new_status", F.col("t").cast("timestamp").alias("changed_at"), "change_id").write.mode("append").json(landing)
        S.start_status(spark.readStream.schema(schema).json(landing), table, state).awaitTermination()
        return {r["id"]: r["status"] for r in read_table(spark, table, S.STATUS).collect()}

    assert step(("p", "1", "applied", "2025-01-02", 1), ("p", "1", "new", "2025-01-01", 2), ("p", "2", "new", "2025-01-01", 3)) == {"1": "applied", "2": "new"}
    assert step(("p", "1", "skipped", "2025-01-01", 4), ("p", "2", "skipped", "2025-01-05", 5)) == {"1": "applied", "2": "skipped"}


def test_embedding_run_is_incremental(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("p", str(i), "Engineer", "Acme", "Remote", f"about the role {i}\n\nSalary: {i}", True) for i in range(4)]
    postings = spark.createDataFrame(rows, "profile string, id string, title string, company string, location string, raw_text string, scrape_qualified boolean")
    postings = postings.withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))
    now = F.lit("2025-01-31").cast("timestamp")

    def stored():
        return sorted((r["job_id"], r["chunk_key"]) for r in read_table(spark, path, CHUNKS).collect())

    def scores(*ids):
        return spark.createDataFrame([("p", i) for i in ids], "profile string, job_id string")

    embed_pending(postings, scores("0", "1"), path, now)
    first = stored()
    assert {j for j, _ in first} == {"0", "1"}
    files = {f for f in pathlib.Path(path).rglob("*.parquet")}
    embed_pending(postings, scores("0", "1"), path, now)
    assert stored() == first
    embed_pending(postings, scores("0", "1", "3"), path, now)
    # A further run appends: the earlier files are as they were.
    assert files <= set(pathlib.Path(path).rglob("*.parquet")) and {j for j, _ in stored()} == {"0", "1", "3"}
    embed_pending(postings, scores("0", "1", "2"), path, now, force=True)
    assert {j for j, _ in stored()} == {"0", "1", "2", "3"} and len(stored()) == len(set(stored()))


def test_rolling_usage_against_brute_force_under_skew(spark):
    import random

    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"p{i % 7}", i, rnd.randint(0, 200_000) + rnd.choice([0.0, 0.5]), rnd.randint(1, 900)) for i in range(700)]
    rows += [("hot", 1000 + i, 500.0, 10) for i in range(5)] + [("hot", 2000, 560.0, 1), ("hot", 2001, 500.0 + 86_400, 1)]
    df = spark.createDataFrame(rows, "provider string, request_id bigint, s double, tokens bigint")
    log = df.select("provider", "request_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")).alias("ts"), "tokens")
    got = {r["request_id"]: (r["requests_60s"], r["tokens_60s"], r["requests_24h"]) for r in rolling_usage(log, 5, 2000, 100, bucket_seconds=600).collect()}
    for provider, i, s, _ in rows:
        minute = [x for x in rows if x[0] == provider and s - 60 <= x[2] <= s]
        day = [x for x in rows if x[0] == provider and s - 86_400 <= x[2] <= s]
        assert got[i] == (len(minute), sum(x[3] for x in minute), len(day))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_thread_in_three_batches_gives_the_batch_result(spark, profile_rows, tmp_path, order):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    as_of = F.lit("2025-01-31").cast("timestamp")
    p = profiles(profile_rows)
    thread = [payload for payload in all_payloads() if payload[0] == "hackernews"]
    assert len(thread) >= 3
    batch = {r["id"] for r in ingest(raw_rows(spark, *thread), p, as_of).collect()}
    assert batch
    groups = [thread[:1], thread[1:2], thread[2:]]
    for k in order:
        landed(spark, landing, *groups[k])
        S.start_ingest(S.read_landing(spark, landing), p, table, state, as_of).awaitTermination()
    stored = [r["id"] for r in read_table(spark, table, POSTINGS).collect()]
    assert sorted(stored) == sorted(batch)
