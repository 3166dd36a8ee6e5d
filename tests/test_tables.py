import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siftwork.session import shared_dir
from siftwork.sources import tables as T

SCHEMA = "id string, title string, created_at timestamp, profile string, source string"
KEYS, PARTS = ["profile", "source", "id"], ["profile", "source"]


def rows(spark, *data):
    df = spark.createDataFrame([(i, t, d, p, s) for i, t, d, p, s in data], "id string, title string, d string, profile string, source string")
    return df.select("id", "title", F.col("d").cast("timestamp").alias("created_at"), "profile", "source")


def content(spark, path):
    return sorted((r["profile"], r["source"], r["id"], r["title"]) for r in T.read_table(spark, path, SCHEMA).collect())


def test_first_write_wins_and_second_run_is_a_no_op(spark, tmp_path):
    path = str(tmp_path / "postings")
    batch = rows(spark, ("1", "late", "2025-01-02", "p", "a"), ("1", "early", "2025-01-01", "p", "a"), ("2", "x", "2025-01-01", "p", "b"))
    for _ in range(2):
        T.append_new(batch, path, SCHEMA, KEYS, PARTS, "created_at")
    assert content(spark, path) == [("p", "a", "1", "early"), ("p", "b", "2", "x")]
    T.append_new(rows(spark, ("1", "newer", "2025-02-01", "p", "a"), ("3", "y", "2025-02-01", "q", "a")), path, SCHEMA, KEYS, PARTS, "created_at")
    assert content(spark, path) == [("p", "a", "1", "early"), ("p", "b", "2", "x"), ("q", "a", "3", "y")]


def test_hot_key_is_combined_before_the_shuffle(spark):
    hot = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("arrival")
    )
    first = T.first_arrivals(hot, ["k"])
    assert first.where("k = 'hot'").collect()[0]["arrival"] == 1
    assert first.count() == 1667 + 1
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    T.append_new(rows(spark, ("1", "x", "2025-01-01", "p", "a"), ("2", "y", "2025-01-01", "p", "b")), path, SCHEMA, KEYS, PARTS, "created_at")
    other = os.path.join(path, "profile=p", "source=b")
    before = sorted(os.listdir(other))
    T.upsert_table(rows(spark, ("1", "X", "2025-01-02", "p", "a"), ("3", "z", "2025-01-02", "p", "a")), path, SCHEMA, KEYS, PARTS)
    assert content(spark, path) == [("p", "a", "1", "X"), ("p", "a", "3", "z"), ("p", "b", "2", "y")]
    assert sorted(os.listdir(other)) == before


def test_replace_group_and_empty_group(spark):
    target = spark.createDataFrame([("j1", "m", 1), ("j1", "m", 2), ("j2", "m", 3)], "job_id string, model string, n int")
    new = spark.createDataFrame([("j1", "m", 9)], "job_id string, model string, n int")
    replaced = T.replace_group(new, target, ["job_id", "model"])
    assert sorted(r["n"] for r in replaced.collect()) == [3, 9]
    emptied = T.replace_group(new.limit(0), target, ["job_id", "model"], groups=new)
    assert sorted(r["n"] for r in emptied.collect()) == [3]


def test_delete_rewrites_and_drops_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    T.append_new(
        rows(spark, ("1", "x", "2025-01-01", "p", "a"), ("2", "y", "2025-01-01", "p", "a"), ("3", "y", "2025-01-01", "p", "b"), ("4", "k", "2025-01-01", "q", "a b")),
        path, SCHEMA, KEYS, PARTS, "created_at",
    )
    T.delete_from_table(spark, path, SCHEMA, F.col("title") == "y", PARTS)
    assert content(spark, path) == [("p", "a", "1", "x"), ("q", "a b", "4", "k")]
    T.delete_from_table(spark, path, SCHEMA, F.col("profile") == "q", PARTS)
    assert content(spark, path) == [("p", "a", "1", "x")]


def test_status_change_and_undo(spark):
    postings = spark.createDataFrame([("p", "1", "new"), ("p", "2", "applied"), ("p", "3", "new")], "profile string, id string, status string")
    changes = spark.createDataFrame(
        [("p", "1", "skipped", 1), ("p", "1", "applied", 2), ("p", "2", "applied", 1), ("p", "gone", "applied", 1)],
        "profile string, id string, new_status string, changed_at int",
    )
    log = T.status_change_log(postings, changes)
    assert [(r["id"], r["previous_status"], r["new_status"]) for r in log.collect()] == [("1", "new", "applied")]
    changed = T.apply_status_changes(postings, log)
    assert {r["id"]: r["status"] for r in changed.collect()} == {"1": "applied", "2": "applied", "3": "new"}
    assert sorted(T.undo_status_changes(changed, log).collect()) == sorted(postings.collect())


def test_missing_table_reads_empty_only_with_schema(spark, tmp_path):
    assert T.read_table(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    with pytest.raises(AnalysisException):
        T.read_table(spark, str(tmp_path / "none"))


def test_status_and_attempts_are_written_and_staging_is_removed(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    left = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("staged-")}
    before = left()
    schema = "id string, status string, score_attempts int, score_error string, profile string"
    spark.createDataFrame([("1", "new", 0, None, "p"), ("2", "new", 0, None, "p"), ("3", "new", 0, None, "q")], schema).write.partitionBy("profile").parquet(path)
    other = sorted(os.listdir(os.path.join(path, "profile=q")))
    changes = spark.createDataFrame([("p", "1", "applied", 1), ("p", "x", "applied", 1)], "profile string, id string, new_status string, changed_at int")
    T.change_status_in_table(changes, path, schema, ["profile"], log)
    attempts = spark.createDataFrame([("p", "2", 1, "late"), ("p", "2", 2, None)], "profile string, id string, tried_at int, error string")
    T.record_attempts_in_table(attempts, path, schema, ["profile"])
    found = {r["id"]: (r["status"], r["score_attempts"], r["score_error"]) for r in T.read_table(spark, path, schema).collect()}
    assert found == {"1": ("applied", 0, None), "2": ("new", 2, "late"), "3": ("new", 0, None)}
    assert sorted(os.listdir(os.path.join(path, "profile=q"))) == other
    assert [r["previous_status"] for r in T.read_table(spark, log).collect()] == ["new"]
    assert left() == before
