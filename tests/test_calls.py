"""Model calls through the table of answers: counted, batched, never repeated."""

import pathlib

import pytest
from pyspark.sql import functions as F

from siftwork.operators import calls, chunking, rerank, scoring
from siftwork.sources.tables import read_table

ROWS = [("p", str(i), "summary", 0, f"text {i % 7}") for i in range(60)] + [("p", "60", "summary", 0, None), ("p", "61", "summary", 0, ""), ("q", "62", "summary", 0, "text 0")]
CHUNKS = "profile string, job_id string, chunk_key string, chunk_order int, chunk_text string"


@pytest.fixture
def counter(spark):
    return spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)


def encoder(counter):
    seen, largest = counter

    def make():
        def encode(texts):
            seen.add(len(texts))
            largest.add(len(texts) > 4)
            return [[3.0, 4.0 * len(t)] for t in texts]

        return encode

    return make


def test_each_distinct_text_is_encoded_once(spark, tmp_path, counter):
    path, seen = str(tmp_path / "answers"), counter[0]
    chunks = spark.createDataFrame(ROWS, CHUNKS).repartition(5)
    out = chunking.embed_chunks(chunks, "m", encoder(counter), path, batch_size=4)
    assert seen.value == 8 and counter[1].value == 0  # seven texts and the empty one; never more than four at a time
    rows = {r["job_id"]: r for r in out.collect()}
    assert len(rows) == len(ROWS) and {len(r["embedding"]) for r in rows.values()} == {2} and rows["5"]["dimensions"] == 2
    assert rows["60"]["embedding"] == rows["61"]["embedding"] == [1.0, 0.0] and rows["62"]["embedding"] == rows["0"]["embedding"]
    plain = {r["job_id"]: r["embedding"] for r in chunking.embed_chunks(chunks.na.fill(""), "m", encoder(counter)).collect()}
    assert plain == {i: r["embedding"] for i, r in rows.items()}


def test_a_second_run_makes_no_call(spark, tmp_path, counter):
    path, seen = str(tmp_path / "answers"), counter[0]
    chunks = spark.createDataFrame(ROWS, CHUNKS)
    chunking.embed_chunks(chunks, "m", encoder(counter), path)
    files = set(pathlib.Path(path).rglob("*.parquet"))
    for _ in range(2):
        chunking.embed_chunks(chunks, "m", encoder(counter), path).collect()
    assert seen.value == 8 and set(pathlib.Path(path).rglob("*.parquet")) == files
    # New texts alone cost calls; another model has answers of its own.
    more = chunks.unionByName(spark.createDataFrame([("p", "70", "summary", 0, "new"), ("p", "71", "summary", 0, "new")], CHUNKS))
    chunking.embed_chunks(more, "m", encoder(counter), path)
    assert seen.value == 9
    chunking.embed_chunks(more, "other", encoder(counter), path)
    assert seen.value == 18


def test_calls_of_a_failed_run_are_not_lost(spark, tmp_path, counter):
    """What was stored before a failure is found by the next run, and a call stored twice gives one answer."""
    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([(f"t{i}",) for i in range(10)], "t string")
    calls.answered(rows.where("t < 't5'"), path, "m", ["t"], lambda: lambda t: t, "string", 3)

    def fails():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        calls.answered(rows, path, "m", ["t"], fails, "string", 3)
    assert calls.missing_calls(rows, path, "m", ["t"], "string").count() == 5
    read_table(spark, path).write.mode("append").partitionBy("model", "shelf").parquet(path + "-twice")
    for _ in range(2):
        read_table(spark, path).write.mode("append").partitionBy("model", "shelf").parquet(path + "-twice")
    out = calls.answered(rows, path + "-twice", "m", ["t"], lambda: lambda t: t, "string", 3)
    assert sorted((r["t"], r["answer"]) for r in out.collect()) == [(f"t{i}", f"t{i}") for i in range(10)]


def test_inputs_are_told_apart(spark, tmp_path):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", "abc"), (None, "abc"), ("1:a", "")], "a string, b string")
    out = calls.answered(rows, str(tmp_path / "x"), "m", ["a", "b"], lambda: lambda a, b: [f"{x}|{y}" for x, y in zip(a, b)], "string", 2)
    assert sorted(r["answer"] for r in out.collect()) == ["1:a|", "ab|c", "a|bc", "|abc", "|abc"]
    with pytest.raises(Exception, match="1 answers"):
        calls.answered(rows, str(tmp_path / "y"), "m", ["a", "b"], lambda: lambda a, b: ["x"], "string", 5)


def test_pair_scores_and_responses(spark, tmp_path, counter):
    path, seen = str(tmp_path / "answers"), counter[0]
    selected = spark.createDataFrame([("q1", "engineer", "summary", "Text\n\n a"), ("q2", "engineer", "summary", "Text\n\n a"), ("q3", "chef", "summary", "Text\n\n a")], "query_id string, match_query string, chunk_key string, chunk_text string")

    def model():
        def score(queries, texts):
            seen.add(len(queries))
            return [float(len(q)) for q in queries]

        return score

    for _ in range(2):
        out = rerank.cached_raw_scores(selected, model, "pairs", path)
        assert sorted((r["query_id"], r["raw_score"]) for r in out.collect()) == [("q1", 8.0), ("q2", 8.0), ("q3", 4.0)]
        assert out.columns == [*selected.columns, "raw_score"] and seen.value == 2
    postings = spark.createDataFrame([("p", "1", "T", "x"), ("p", "2", "T", "x"), ("q", "1", "T", "x")], "profile string, id string, title string, raw_text string")
    answers = scoring.cached_responses(postings, lambda: lambda p, t, x: [f"{a}/{b}/{c}" for a, b, c in zip(p, t, x)], "judge", path)
    assert sorted(map(tuple, answers.collect())) == [("p", "1", "p/T/x"), ("p", "2", "p/T/x"), ("q", "1", "q/T/x")]
