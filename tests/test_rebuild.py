"""Versions of a vector index: what readers see before, during and after a rebuild."""

import pathlib

import pytest
from pyspark.sql import functions as F

from siftwork.operators.chunking import dimension_conflicts
from siftwork.plans import rebuild as R

SCHEMA = "uid string, job_id string, chunk_key string, chunk_order int, chunk_text string, embedding array<float>, profile string, model_name string"


def rows(spark, odd=()):
    data = [(f"{p}{m}{i}", str(i), "summary", 0, f"text {i % 3}", [1.0] * (3 if (p, i) in odd else 2), p, m) for p in ("a", "b") for m in ("m/1", "n") for i in range(6)]
    return spark.createDataFrame(data, SCHEMA)


def seen(spark, path):
    return {(r["profile"], r["model_name"]): (r["n"], r["d"]) for r in R.read_index(spark, path).groupBy("profile", "model_name").agg(F.count("*").alias("n"), F.collect_set("dimensions").alias("d")).collect()}


def encoder(calls):
    def make():
        def encode(texts):
            calls.add(len(texts))
            return [[1.0, 2.0, 3.0, 4.0] for _ in texts]

        return encode

    return make


WHOLE = {("a", "m/1"): (6, [2]), ("a", "n"): (6, [2]), ("b", "m/1"): (6, [2]), ("b", "n"): (6, [2])}


def broken(spark, path):
    """An index one of whose groups was given vectors of two lengths by a writer without checks."""
    R.write_version(rows(spark), path)
    bad = rows(spark, {("a", 1)}).where("profile = 'a' and model_name = 'm/1'").withColumn("version", F.lit(1).cast("long")).withColumn("dimensions", F.size("embedding"))
    bad.select(*R._columns(R.ROWS)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*R.PARTITIONS).parquet(path)


def test_conflicts_are_rebuilt_and_the_rest_stays(spark, tmp_path):
    path, calls = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    broken(spark, path)
    assert [(r["profile"], r["model_name"]) for r in dimension_conflicts(R.read_index(spark, path)).collect()] == [("a", "m/1")]
    before = set(pathlib.Path(path).rglob("*.parquet"))
    R.rebuild_conflicts(spark, path, encoder(calls))
    assert seen(spark, path) == {**WHOLE, ("a", "m/1"): (6, [4])} and calls.value == 3
    assert before <= set(pathlib.Path(path).rglob("*.parquet"))
    R.drop_old_versions(spark, path)
    assert seen(spark, path) == {**WHOLE, ("a", "m/1"): (6, [4])}
    assert {str(f).split("version=")[1][0] for f in pathlib.Path(path).rglob("*.parquet") if "profile=a" in str(f) and "model_name=m" in str(f)} == {"2"}
    R.rebuild_conflicts(spark, path, encoder(calls))
    assert calls.value == 3


def test_readers_see_the_old_version_until_the_end(spark, tmp_path):
    path, calls = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    R.write_version(rows(spark), path)
    group = spark.createDataFrame([("a", "n")], "profile string, model_name string")

    def fails():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        R.rebuild(spark, path, group, fails)
    assert seen(spark, path) == WHOLE
    with pytest.raises(ValueError, match="2 and 3 dimensions in one group: a, n"):
        R.write_version(rows(spark, {("a", 1)}).where("profile = 'a' and model_name = 'n'"), path)
    assert seen(spark, path) == WHOLE
    # What the failed ones left is in nobody's way, and is written over.
    R.write_version(rows(spark).where("profile = 'b' and model_name = 'n'"), path)
    assert seen(spark, path) == WHOLE
    R.rebuild(spark, path, group, encoder(calls), str(tmp_path / "answers"))
    assert seen(spark, path) == {**WHOLE, ("a", "n"): (6, [4])}
    R.rebuild(spark, path, group, encoder(calls), str(tmp_path / "answers"))
    assert calls.value == 3 and seen(spark, path) == {**WHOLE, ("a", "n"): (6, [4])}


def test_a_new_model_stands_beside_the_old(spark, tmp_path):
    path, calls = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    R.write_version(rows(spark), path)
    R.rebuild(spark, path, spark.createDataFrame([("a", "n"), ("b", "n")], "profile string, model_name string"), encoder(calls), model_name="new")
    assert seen(spark, path) == {**WHOLE, ("a", "new"): (6, [4]), ("b", "new"): (6, [4])}
    assert R.read_index(spark, str(tmp_path / "none")).count() == 0
