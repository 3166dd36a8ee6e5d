"""Full-text search by trigrams: the rows of a scan, and what is read for them."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import textindex as I

KEYS, COLUMNS = ["profile", "id"], ["title", "body"]
WORDS = "engineer license Straße ÉCOLE 日本語で 𓀀𓀁𓀂𓀃 a.b*c %like_ under_score (paren) data-base naïve".split()


@pytest.fixture(scope="module", autouse=True)
def small_blocks():
    before, I.BLOCK_CHARS = I.BLOCK_CHARS, 3000
    yield
    I.BLOCK_CHARS = before


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [(f"p{i % 5}", str(i), rnd.choice(WORDS), " ".join(rnd.choices(WORDS + ["x" * 9, "lorem", "ipsum\n"], k=30))) for i in range(300)]
    return out + [("p0", "null", None, None), ("p1", "empty", "", ""), ("p2", "edge", "abc", "def"), ("p3", "long", "t", "word " * 30_000 + "needle"), ("p4", "case", "ISTANBUL İ", "ſ")]


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("text"))
    df = spark.createDataFrame(rows, "profile string, id string, title string, body string")
    df.write.partitionBy("profile").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    I.add_to_text_index(stored, f"{path}/index", COLUMNS, KEYS)
    return stored, f"{path}/index"


def scan(table, wanted):
    words = wanted.lower().strip()
    return {(r["profile"], r["id"]) for r in table.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(words)) | F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit(words))).collect()}


@pytest.mark.parametrize("wanted", ["Engineer", " license ", "straße", "école", "日本語", "𓀀𓀁𓀂", "a.b*c", "%like_", "(paren) data", "needle", "c\x01d", "bcd", "zzz", "engineer zzz", "x", "で", "ab", "lorem ipsum", "istanbul", "ipsum\n"])
def test_same_rows_as_a_scan(table, wanted):
    stored, path = table
    for parts in ([], ["profile"]):
        found = [tuple(r) for r in I.search_text(stored, path, wanted, COLUMNS, KEYS, parts).select(*KEYS).collect()]
        assert len(found) == len(set(found)) and set(found) == scan(stored, wanted)


def test_blank_search_keeps_all(table, rows):
    assert I.search_text(table[0], table[1], "  ", COLUMNS, KEYS).count() == len(rows)


def test_only_candidates_are_read(spark, table):
    stored, path = table
    near = I.candidates(spark, path, "needle", KEYS)
    assert [tuple(r) for r in near.collect()] == [("p3", "long")]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "EqualTo(gram,)" in plan
    # A block's rows are sorted by trigram, so that pages have narrow ranges.
    lists = spark.read.parquet(path)
    for block in [r["block"] for r in lists.select("block").distinct().limit(3).collect()]:
        grams = [r["gram"] for r in lists.where(F.col("block") == block).collect()]
        assert grams == sorted(grams) and grams[0] == ""
    search = I.search_text(stored, path, "needle", COLUMNS, KEYS, ["profile"])
    assert search.count() == 1 and "dynamicpruning" in search._jdf.queryExecution().executedPlan().toString()


def test_counts_choose_the_rarest(spark, table):
    grams = I._rarest(spark, table[1], "word needle")
    # Every other trigram of these words stands in more rows than those of "needle".
    assert len(grams) == I.RAREST and all(g in "word needle" for g in grams)
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(table[1]).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    assert max(counts[g] for g in grams) == 1 and counts["lor"] > 100


def test_parts_are_added_and_repeated(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame(rows, "profile string, id string, title string, body string")
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    I.add_to_text_index(df.where(~late), path, COLUMNS, KEYS)
    for _ in range(2):
        I.add_to_text_index(df.where(late), path, COLUMNS, KEYS, 1)
    for wanted in ("license", "needle", "istanbul"):
        assert {(r["profile"], r["id"]) for r in I.search_text(df, path, wanted, COLUMNS, KEYS).collect()} == scan(df, wanted)
    members = [tuple(m) for r in spark.read.parquet(path).where("gram = ''").collect() for m in r["members"]]
    assert len(members) == len(set(members)) == len(rows)
    # A changed text is found by its new words, and no longer by its old ones.
    changed = df.withColumn("body", F.when(F.col("id") == "long", "haystack").otherwise(F.col("body")))
    I.add_to_text_index(changed.where("id = 'long'"), path, COLUMNS, KEYS, 2)
    assert I.search_text(changed, path, "haystack", COLUMNS, KEYS).count() == 1 and I.search_text(changed, path, "needle", COLUMNS, KEYS).count() == 0
