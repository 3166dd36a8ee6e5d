"""Vector search against brute force: bounds, streaming groups, the approximate index and its recall."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from siftwork.operators import ivf
from siftwork.operators import retrieval as N
from tests.conftest import DATA

CHUNKS, QUERIES = "profile string, uid string, embedding array<float>", "profile string, query_id string, query_vec array<float>"


def clustered(n, size=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    return (centres[rng.integers(groups, size=n)] + 0.4 * rng.normal(size=(n, size))).astype("float32")


@pytest.fixture(scope="module")
def rows():
    """A hot profile with most chunks, small ones, equal vectors, a zero vector, other lengths and missing vectors."""
    vectors = clustered(6000)
    chunks = [("hot" if i % 10 else f"p{i % 30}", f"u{i:05d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks += [("hot", f"same{i}", chunks[1][2]) for i in range(30)] + [("hot", "zero", [0.0] * 16), ("hot", "short", [1.0, 2.0]), ("hot", "none", None), ("hot", "empty", [])]
    queries = [("hot" if i % 4 else f"p{i % 3 * 10}", f"q{i:03d}", [float(x) for x in v]) for i, v in enumerate(clustered(60, seed=4))]
    queries += [("hot", "same", chunks[1][2]), ("hot", "zero", [0.0] * 16), ("hot", "short", [2.0, 1.0]), ("nobody", "alone", queries[0][2]), ("hot", "none", None)]
    return chunks, queries


def exact(rows, k, metric="cosine"):
    chunks, queries = rows
    out = set()
    for profile, query_id, vector in queries:
        same = [(u, v) for p, u, v in chunks if p == profile and v and vector and len(v) == len(vector)]
        if same:
            d = N._distances(np.array([v for _, v in same], "float64"), np.array([vector], "float64"), metric)[:, 0]
            near = sorted(zip(d.tolist(), [u for u, _ in same]))[:k]
            out |= {(query_id, u, round(x, 8), i) for i, (x, u) in enumerate(near, 1)}
    return out


def found(df):
    return {(r["query_id"], r["uid"], round(r["distance"], 8), r["rank"]) for r in df.collect()}


def frames(spark, rows):
    return spark.createDataFrame(rows[0], CHUNKS), spark.createDataFrame(rows[1], QUERIES)


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
@pytest.mark.parametrize("broadcast", [4096, 0])
@pytest.mark.parametrize("every", [None, 8])
def test_exact_search(spark, rows, monkeypatch, metric, broadcast, every):
    monkeypatch.setattr(N, "SLICE_ROWS", 700)
    monkeypatch.setattr(N, "LEAST_SLICE_ROWS", 300)
    monkeypatch.setattr(N, "DISTANCE_BLOCK", 7)
    chunks, queries = frames(spark, rows)
    assert found(N.nearest(chunks, queries, 9, metric, broadcast, every)) == exact(rows, 9, metric)


@pytest.mark.parametrize("broadcast", [4096, 0])
def test_few_rows_leave_the_tasks(spark, rows, monkeypatch, broadcast):
    """With a bound the rows of a query don't grow with the tasks: some k * every in all, not k a task."""
    monkeypatch.setattr(N, "SLICE_ROWS", 100)
    monkeypatch.setattr(N, "LEAST_SLICE_ROWS", 50)
    k, every = 10, 16
    hot = [r for r in rows[1] if r[0] == "hot" and r[2] and len(r[2]) == 16 and any(r[2])]
    chunks, queries = spark.createDataFrame(rows[0], CHUNKS).repartition(64), spark.createDataFrame(hot, QUERIES)
    with_bound = N._all_hits(chunks, queries, k, "cosine", broadcast, every)[0].count()
    without = N._all_hits(chunks, queries, k, "cosine", broadcast, None)[0].count()
    assert without > 50 * k * len(hot)
    assert with_bound < 2 * every * k * len(hot) and with_bound < without / 2


def test_every_chunk_moves_once(spark, rows, monkeypatch):
    """The rows that meet in the groups: each chunk in one, each query in every slice of its profile."""
    monkeypatch.setattr(N, "SLICE_ROWS", 700)
    met = []
    monkeypatch.setattr(N, "streamed_hits", lambda chunks, queries, k, metric: met.append((chunks, queries)) or chunks)
    chunks, queries = frames(spark, rows)
    N._shuffled_hits(chunks, queries, 5, "cosine")
    left, right = met[0]
    per_chunk = left.groupBy("uid").count().agg(F.max("count")).first()[0]
    assert per_chunk == 1 and left.groupBy("grp").count().agg(F.max("count")).first()[0] < 2 * 700
    slices = left.select("grp").distinct().where(F.col("grp").endswith("/hot")).count()
    assert right.where("query_id = 'same'").count() == slices > 5


def test_a_profile_with_many_queries_has_smaller_slices(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "LEAST_SLICE_ROWS", 50)
    monkeypatch.setattr(N, "SLICE_DISTANCES", 5000)
    chunks, queries = frames(spark, rows)
    assert found(N.nearest(chunks, queries, 3, "cosine", 0)) == exact(rows, 3)


def test_queries_are_held_and_have_k_hits(spark, rows, monkeypatch):
    """A profile in one slice: the tasks hold a bounded number of queries each and pass on k hits a query, whatever k is."""
    monkeypatch.setattr(N, "HELD_QUERIES", 16)
    met, own = [], N.streamed_hits
    monkeypatch.setattr(N, "streamed_hits", lambda chunks, queries, k, metric: met.append(queries) or own(chunks, queries, k, metric))
    hot = [r for r in rows[1] if r[0] == "hot" and r[2] and len(r[2]) == 16]
    chunks, queries = spark.createDataFrame(rows[0], CHUNKS).repartition(16), spark.createDataFrame(hot, QUERIES)
    hits, _ = N._all_hits(chunks, queries, 10, "cosine", 0, None)
    assert hits.count() == 10 * len(hot)
    assert met[0].count() == len(hot) and met[0].groupBy("grp").count().agg(F.max("count")).first()[0] <= 32
    assert found(N.nearest(chunks, queries, 10, "cosine", 0)) == exact((rows[0], hot), 10)


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_single_precision_rules_out_no_neighbour(metric):
    """Near ties, long and short vectors, zeros and values that single precision can't hold."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1, 24))
    for scale in (1.0, 1e-3, 1e3, 1e25):
        chunks = np.concatenate([base + 1e-7 * rng.normal(size=(300, 24)), rng.normal(size=(300, 24)), np.zeros((3, 24))]) * scale
        queries = np.concatenate([base, rng.normal(size=(5, 24)), np.zeros((1, 24))]) * scale
        held = N._HeldQueries([str(i) for i in range(7)], queries, np.full(7, np.inf), 9, metric)
        for start in range(0, len(chunks), 200):
            part = chunks[start : start + 200]
            held.add(start + np.arange(len(part)), part, N._Single(part, metric, query=False))
        held.cut()
        d = N._distances(chunks, queries, metric)
        for i in range(7):
            near = np.sort(d[:, i])[:9]
            assert np.allclose(held.best[1][held.best[0] == i], near, rtol=1e-9, atol=max(2e-9, 1e-12 * scale**2))


# The approximate index


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    chunks, _ = frames(spark, rows)
    return ivf.build_index(chunks, str(tmp_path_factory.mktemp("index") / "own"), sample=1500)


def recall(hits, expected):
    return len({h[:2] for h in hits} & {h[:2] for h in expected}) / len(expected)


def test_all_lists_give_the_exact_answer(spark, rows, index):
    _, queries = frames(spark, rows)
    assert found(ivf.search_index(index, queries, 9, index.cells)) == exact(rows, 9)


def test_recall_of_the_probed_lists(spark, rows, index):
    _, queries = frames(spark, rows)
    assert index.probes < index.cells / 2
    hits = found(ivf.search_index(index, queries, 10))
    # The zero vector has no direction, so no list is nearer to it than another.
    expected = {h for h in exact(rows, 10) if h[0] != "zero"}
    assert recall(hits, expected) >= 0.9


def test_recall_on_the_given_table(spark, tmp_path):
    """Every row whose id is divisible by 50 asks for its neighbours among all rows."""
    table = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    chunks = table.select(F.lit("p").alias("profile"), F.col("vec_id").cast("string").alias("uid"), "embedding")
    queries = table.where("vec_id % 50 = 0").select(F.lit("p").alias("profile"), F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vec"))
    own = ivf.build_index(chunks, str(tmp_path / "index"))
    expected = found(N.nearest(chunks, queries, 10))
    assert recall(found(ivf.search_index(own, queries, 10)), expected) >= 0.9


def test_every_chunk_lies_in_one_bounded_slice(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(ivf, "LIST_ROWS", 100)
    chunks, queries = frames(spark, rows)
    own = ivf.build_index(chunks, str(tmp_path / "index"), cells=4, sample=500)
    lists = spark.read.parquet(f"{own.path}/lists")
    assert lists.count() == lists.select("uid").distinct().count() == sum(1 for r in rows[0] if r[2])
    assert lists.groupBy("profile", "cell", "part", "slice").count().agg(F.max("count")).first()[0] < 250
    assert [r["uid"] for r in lists.where(f"cell = {ivf.UNPLACED}").collect()] == ["short"]
    assert found(ivf.search_index(own, queries, 9, 4)) == exact(rows, 9)


def test_added_chunks_are_found(spark, rows, tmp_path):
    chunks, queries = frames(spark, rows)
    late = F.pmod(F.xxhash64("uid"), F.lit(3)) == 0
    own = ivf.build_index(chunks.where(~late), str(tmp_path / "index"), sample=800)
    before = sorted(spark.read.parquet(f"{own.path}/lists").inputFiles())
    ivf.add_to_index(own, chunks.where(late))
    assert set(before) < set(spark.read.parquet(f"{own.path}/lists").inputFiles())
    assert found(ivf.search_index(ivf.open_index(spark, own.path), queries, 9, own.cells)) == exact(rows, 9)


def test_only_probed_lists_are_read(spark, rows, index):
    _, queries = frames(spark, rows)
    plan = ivf.search_index(index, queries, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_an_empty_index(spark, rows, tmp_path):
    chunks, queries = frames(spark, rows)
    own = ivf.build_index(chunks.limit(0), str(tmp_path / "index"))
    assert ivf.search_index(own, queries, 5).collect() == []
    ivf.add_to_index(own, chunks)
    assert found(ivf.search_index(own, queries, 5, own.cells)) == exact(rows, 5)


def test_a_query_moves_once_however_many_lists_it_probes(spark, rows, index, monkeypatch):
    met, own = [], N.streamed_hits
    monkeypatch.setattr(N, "streamed_hits", lambda chunks, queries, k, metric: met.append(queries) or own(chunks, queries, k, metric))
    _, queries = frames(spark, rows)
    hits = found(ivf.search_index(index, queries, 9, index.cells - 1))
    assert met and met[0].groupBy("query_id").count().agg(F.max("count")).first()[0] == 1
    near = found(ivf.search_index(index, queries, 9, index.cells - 1, max_distance=0.4))
    assert near == {h for h in hits if h[2] <= 0.4}
