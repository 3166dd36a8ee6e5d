"""Attempt ledger and status log: repeated batches, failures half way, files that stay as they are."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from siftwork.sources import ledger as L
from siftwork.sources import statuses as C
from siftwork.sources import tables as T
from siftwork.streaming import ingest as S

ATTEMPTS = "profile string, id string, tried_at timestamp, error string"
POSTS = "id string, score_attempts int, score_error string, profile string"


def tries(spark, *rows):
    df = spark.createDataFrame([(p, i, f"2025-01-01 00:00:{t:02d}", e) for p, i, t, e in rows], "profile string, id string, tried_at string, error string")
    return df.withColumn("tried_at", F.col("tried_at").cast("timestamp"))


def totals(spark, path):
    return {(r["profile"], r["id"]): (r["tries"], r["error"]) for r in L.totals(spark, path).collect()}


BATCHES = [
    [("p", "1", 1, "first"), ("p", "1", 3, None), ("p", "1", 2, "second"), ("q", "1", 1, None)],
    [("p", "1", 5, None), ("p", "2", 5, "x" * 900)],
    [("p", "1", 9, "third"), ("r", "9", 9, None)],
    [("p", "2", 12, None)],
]
EXPECTED = {("p", "1"): (5, "third"), ("q", "1"): (1, None), ("p", "2"): (2, "x" * 500), ("r", "9"): (1, None)}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert totals(spark, path) == {}
    for number, rows in enumerate(BATCHES):
        for _ in range(2):
            L.append_attempts(tries(spark, *rows), path, number)
    assert totals(spark, path) == EXPECTED


@pytest.mark.parametrize("fold_after", [(0,), (1, 2, 3), (3,), (2, 2, 3)])
def test_folds_change_nothing(spark, tmp_path, fold_after):
    path = str(tmp_path / "ledger")
    for number, rows in enumerate(BATCHES):
        L.append_attempts(tries(spark, *rows), path, number)
        for _ in range(fold_after.count(number)):
            L.fold(spark, path)
        # The newest batch and those already folded may come again.
        for again in range(number + 1):
            L.append_attempts(tries(spark, *BATCHES[again]), path, again)
    assert totals(spark, path) == EXPECTED
    if 3 in fold_after:
        assert L.last_fold(spark, path)[1] == 2 and [r["batch"] for r in spark.read.parquet(path).select("batch").distinct().collect()] == [3]


def test_a_fold_that_fails_half_way_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    for number, rows in enumerate(BATCHES):
        L.append_attempts(tries(spark, *rows), path, number)

    def fails(*_):
        raise RuntimeError("lost")

    # Totals are written, the old batches are still there: both before and after the fold's own row.
    with monkeypatch.context() as m:
        m.setattr(L, "drop_partition", fails)
        with pytest.raises(RuntimeError):
            L.fold(spark, path)
        assert totals(spark, path) == EXPECTED
    written = L._summed(spark, path, 2).withColumn("fold", F.lit(2).cast("long"))
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(f"{path}-totals")
    assert totals(spark, path) == EXPECTED
    L.append_attempts(tries(spark, ("p", "1", 20, "last")), path, 4)
    L.fold(spark, path)
    assert totals(spark, path) == {**EXPECTED, ("p", "1"): (6, "last")}


def test_resets_end_earlier_tries(spark, tmp_path):
    path = str(tmp_path / "ledger")
    L.append_attempts(tries(spark, *BATCHES[0]), path, 0)
    for _ in range(2):
        L.append_resets(spark.createDataFrame([("p", "1")], "profile string, id string"), path, 1)
    assert totals(spark, path) == {("q", "1"): (1, None)}
    L.append_attempts(tries(spark, ("p", "1", 30, "new")), path, 2)
    L.fold(spark, path)
    L.append_attempts(tries(spark, ("p", "1", 31, None)), path, 3)
    assert totals(spark, path) == {("p", "1"): (2, "new"), ("q", "1"): (1, None)}


def test_the_posting_table_follows_the_ledger(spark, tmp_path):
    path, table = str(tmp_path / "ledger"), str(tmp_path / "postings")
    posts = [("1", 0, None, "p"), ("2", 7, "old", "p"), ("1", 0, None, "q"), ("9", 0, None, "r"), ("8", 0, None, "s")]
    spark.createDataFrame(posts, POSTS).write.partitionBy("profile").parquet(table)
    untouched = set(pathlib.Path(table, "profile=s").iterdir())
    for number, rows in enumerate(BATCHES):
        L.append_attempts(tries(spark, *rows), path, number)
    for _ in range(2):
        L.attempts_into_table(spark, path, table, POSTS, ["profile"])
        rows = {(r["profile"], r["id"]): (r["score_attempts"], r["score_error"]) for r in T.read_table(spark, table, POSTS).collect()}
        assert rows == {**EXPECTED, ("s", "8"): (0, None)}
    assert set(pathlib.Path(table, "profile=s").iterdir()) == untouched
    before = set(pathlib.Path(table).rglob("*.parquet"))
    L.attempts_into_table(spark, path, table, POSTS, ["profile"])
    assert set(pathlib.Path(table).rglob("*.parquet")) == before


# Statuses


def changes(spark, rows):
    df = spark.createDataFrame([(p, i, s, f"2025-01-{t:02d}", n) for p, i, s, t, n in rows], "profile string, id string, new_status string, t string, change_id long")
    return df.select("profile", "id", "new_status", F.col("t").cast("timestamp").alias("changed_at"), "change_id")


def newest(rows):
    out = {}
    for p, i, s, t, n in rows:
        out[p, i] = max(out.get((p, i), (0, -1, "")), (t, n, s))
    return {k: v[2] for k, v in out.items()}


def statuses(spark, path):
    return {(r["profile"], r["id"]): r["status"] for r in C.current_statuses(spark, path).collect()}


def random_changes(seed, n):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.7 else f"p{rnd.randint(0, 3)}", str(rnd.randint(0, 40)), rnd.choice(["new", "applied", "skipped"]), rnd.randint(1, 28), 1000 * seed + k) for k in range(n)]


def files(path):
    return set(pathlib.Path(path).rglob("*.parquet"))


def test_a_batch_leaves_all_other_files(spark, tmp_path):
    path = str(tmp_path / "log")
    seen = []
    for batch in range(4):
        rows = random_changes(batch, 60) if batch != 2 else [("hot", "3", "applied", 28, 10**6)]
        before = files(path)
        for _ in range(2):
            C.append_changes(changes(spark, rows), path, batch, 8)
        seen += rows
        assert before <= files(path) and len(files(path) - before) <= 8
        if batch == 2:
            assert len(files(path) - before) == 1
    assert statuses(spark, path) == newest(seen)


def test_only_full_buckets_are_folded(spark, tmp_path):
    path = str(tmp_path / "log")
    first = random_changes(1, 200)
    C.append_changes(changes(spark, first), path, 0, 8)
    busy = [("hot", "3", "new", 1, 1)]
    for batch in range(1, 5):
        C.append_changes(changes(spark, busy), path, batch, 8)
    expected, before = statuses(spark, path), files(path)
    folded = C.compact_statuses(spark, path, 4)
    assert len(folded) == 1 and statuses(spark, path) == expected == newest(first + busy)
    others = {f for f in before if f"bucket={folded[0]}" not in str(f)}
    assert others <= files(path) and len(files(path) - others) == 1
    # A folded batch that is repeated, and a fold that is done again, change nothing.
    C.append_changes(changes(spark, busy), path, 4, 8)
    assert statuses(spark, path) == expected
    assert C.compact_statuses(spark, path, 1) and statuses(spark, path) == expected


def test_status_log_as_a_stream(spark, tmp_path):
    landing, path, state = (str(tmp_path / n) for n in ("landing", "log", "state"))
    schema = "profile string, id string, new_status string, changed_at timestamp, change_id bigint"
    seen = []
    for seed in range(5):
        rows = random_changes(seed, 30)
        changes(spark, rows).coalesce(1).write.mode("append").json(landing)
        S.start_status_log(spark.readStream.schema(schema).json(landing), path, state, buckets=4, fold_at=3).awaitTermination()
        seen += rows
        assert statuses(spark, path) == newest(seen)
    per_bucket = T.read_table(spark, path, C.CHANGES).select("bucket", "batch").distinct().groupBy("bucket").count()
    assert per_bucket.agg(F.max("count")).first()[0] <= 4


# Threads


def test_kept_parts_of_threads_are_bounded_and_not_repeated(spark, tmp_path):
    as_of = F.lit("2025-01-31").cast("timestamp")
    rows = [("p", "hackernews", "", day, payload) for day, payload in [("2025-01-30", '{"hits": []}'), ("2025-01-30", '{"id": 1, "text": "a"}'), ("2025-01-30", '{"id": 1, "text": "a"}'), ("2024-11-01", '{"id": 2, "text": "b"}'), (None, '{"id": 3, "kids": [1]}')]]
    batch = spark.createDataFrame(rows, "profile string, source string, company string, d string, payload string").select("profile", "source", "company", F.col("d").cast("timestamp").alias("fetched_at"), "payload")
    parts = S.thread_parts(batch, as_of)
    path = str(tmp_path / "threads")
    for _ in range(2):
        T.append_new(parts, path, S.THREADS, S.THREAD_KEYS, S.THREAD_PARTITIONS, "fetched_at")
    kept = T.read_table(spark, path, S.THREADS)
    assert sorted((r["kind"], r["payload"][:8]) for r in kept.collect()) == [("comment", '{"id": 1'), ("comment", '{"id": 2'), ("list", '{"hits":'), ("list", '{"id": 3')]
    T.delete_from_table(spark, path, S.THREADS, ~S.young_parts(as_of, 35), S.THREAD_PARTITIONS)
    assert T.read_table(spark, path, S.THREADS).count() == 3 and not list(pathlib.Path(path).rglob("day=2024-11-01"))
    # A comment meets the kept lists only, a list the kept comments too; own payloads aren't taken twice.
    kept = T.read_table(spark, path, S.THREADS)
    comment = batch.where(F.get_json_object("payload", "$.text") == "a").limit(1)
    assert sorted(r["payload"][:8] for r in S.with_earlier_threads(comment, kept).collect()) == ['{"hits":', '{"id": 1', '{"id": 3']
    lists = batch.where(F.get_json_object("payload", "$.kids").isNotNull())
    assert sorted(r["payload"][:8] for r in S.with_earlier_threads(lists, kept).collect()) == ['{"hits":', '{"id": 1', '{"id": 3']
