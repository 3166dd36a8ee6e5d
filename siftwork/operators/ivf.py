"""An approximate vector index: inverted lists by the nearest of some centroids, probed list by list.

``build_index`` fits the centroids on a bounded sample, measures on it how many lists a query must probe, and then
places every chunk. ``search_index`` compares a query with all chunks of its profile in the nearest lists, by full
vectors, so distances are exact and only a neighbour in a list that isn't probed can be missed.

Folder of an index: ``centroids`` (cell, centroid), ``facts`` (one row: metric, dimensions, cells, probes, recall, type of a vector),
``lists`` (profile, uid, embedding, cell, part, slice; partitioned by cell) and ``sizes`` (profile, cell, part, n_slices).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators.retrieval import _shuffled_hits, best_hits

SAMPLE = 20_000  # chunks the centroids are fitted on, at most
CELLS = 4_096  # lists, at most
PER_CELL = 8  # sampled chunks per centroid, at least
ROUNDS = 12  # of k-means
LIST_ROWS = 20_000  # chunks of one slice of a list, some
SALTS = 32  # parts of a list when its rows meet their number of slices
RECALL = 0.97  # share of the sample's own neighbours that the probed lists must hold
TESTED = 400  # sampled chunks whose neighbours measure it

UNPLACED = -1  # the list of chunks whose vectors have another length than the centroids'


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    metric: str
    cells: int
    probes: int
    kind: str

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"profile string, uid string, embedding {self.kind}, part int, slice long, cell int").parquet(f"{self.path}/lists")

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.schema("profile string, cell int, part int, n_slices long").parquet(f"{self.path}/sizes")

    @property
    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()  # CELLS rows at most
        return np.array([r["centroid"] for r in rows], dtype="float64")


def _ready(vectors: np.ndarray, metric: str) -> np.ndarray:
    """For the cosine, directions only: the nearest centroid is then the same by either distance."""
    if metric != "cosine":
        return vectors
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def k_means(vectors: np.ndarray, cells: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from spread starting points; an empty cell takes the point that is worst placed."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(vectors)))]
    left = _squared(vectors, vectors[chosen])[:, 0].clip(0)
    while len(chosen) < cells:
        total = left.sum()
        chosen.append(int(rng.choice(len(vectors), p=left / total)) if total > 0 else int(rng.integers(len(vectors))))
        left = np.minimum(left, _squared(vectors, vectors[chosen[-1:]])[:, 0].clip(0))
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        distance = _squared(vectors, centroids)
        nearest = distance.argmin(axis=1)
        counts = np.bincount(nearest, minlength=cells)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
        if not filled.all():
            worst = np.argsort(-distance[np.arange(len(vectors)), nearest])
            centroids[~filled] = vectors[worst[: int((~filled).sum())]]
    return centroids


def probes_for(vectors: np.ndarray, profiles: np.ndarray, centroids: np.ndarray, k: int, recall: float, tested: int = TESTED) -> tuple[int, float]:
    """The fewest lists that hold ``recall`` of the k nearest of sampled chunks among the sample of their profile.

    The sample is thinner than the corpus, so its neighbours are farther off and harder to hold.
    """
    asked = np.arange(0, len(vectors), max(1, len(vectors) // tested))
    order = _squared(vectors[asked], centroids).argsort(axis=1)
    placed = _squared(vectors, centroids).argmin(axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = []
    for row, i in enumerate(asked.tolist()):
        same = np.flatnonzero(profiles == profiles[i])
        near = same[_squared(vectors[i : i + 1], vectors[same])[0].argsort()[:k]]
        needed.append(place[row, placed[near]])
    needed = np.sort(np.concatenate(needed))
    at = min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)
    probes = int(needed[max(at, 0)]) + 1
    return probes, float((needed < probes).mean())


def _placing(centroids: np.ndarray, metric: str):
    """Adds the cell of each row's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = centroids.shape[1]
        for batch in batches:
            column = batch.column("embedding")
            usable = np.asarray(pa.compute.list_value_length(column)) == size
            cells = np.full(batch.num_rows, UNPLACED, np.int32)
            if usable.any():
                flat = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype("float64")
                cells[usable] = _squared(_ready(flat.reshape(-1, size), metric), centroids).argmin(axis=1)
            yield batch.append_column("cell", pa.array(cells))

    return run


def _place(chunks: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    rows = chunks.select(F.col("profile").cast("string"), F.col("uid").cast("string"), "embedding").where(F.size("embedding") > 0)
    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(_placing(centroids, metric), f"profile string, uid string, embedding {kind}, cell int")


def _write_lists(chunks: DataFrame, path: str, centroids: np.ndarray, metric: str, part: int) -> None:
    """Places all chunks, cuts long lists into slices and appends both to the index as one part."""
    spark = chunks.sparkSession
    placed = _place(chunks, centroids, metric).withColumn("part", F.lit(part))
    # Sizes first: a list's rows are counted before they move, and its slices follow from the count.
    sizes = placed.groupBy("profile", "cell", "part").agg(F.ceil(F.count("*") / F.lit(LIST_ROWS)).alias("n_slices"))
    sizes.write.mode("append").parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes").where(F.col("part") == part)
    # A very long list meets its size in parts.
    salted = sizes.drop("part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = placed.withColumn("salt", F.pmod(F.hash("uid"), F.lit(SALTS))).join(salted, ["profile", "cell", "salt"])
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("n_slices"))).drop("salt", "n_slices")
    cut.select("profile", "uid", "embedding", "part", "slice", "cell").repartition("cell", "slice").write.mode("append").partitionBy("cell").parquet(f"{path}/lists")


def build_index(
    chunks: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL,
    k: int = 10, seed: int = 42,
) -> Index:
    """An index of every chunk (profile, uid, embedding) in the folder ``path``.

    Centroids are fitted on at most ``sample`` chunks, drawn by a hash of their ids; all else covers all chunks.
    Without ``cells`` there are as many lists as the root of the number of chunks, up to ``CELLS`` and to an eighth of the
    sample. ``recall`` is what the probed lists must hold of the sample's own k nearest. Chunks without
    a vector are left out, as in the exact search; those of another length go to a list that every query probes.
    """
    if metric not in V.METRICS:
        raise ValueError(f"metric must be one of {V.METRICS}")
    spark = chunks.sparkSession
    usable = chunks.where(F.size("embedding") > 0)
    total = usable.count()
    every = max(1, -(-total // sample))
    drawn = usable.where(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(every)) == 0).select("profile", "embedding").limit(sample).collect()
    lengths = Counter(len(r["embedding"]) for r in drawn)
    size = max(lengths, key=lambda n: (lengths[n], n), default=1)
    drawn = [r for r in drawn if len(r["embedding"]) == size]
    vectors = _ready(np.array([r["embedding"] for r in drawn], dtype="float64").reshape(len(drawn), size), metric)
    cells = max(1, min(cells or round(total**0.5), CELLS, len(drawn) // PER_CELL))
    centroids = k_means(vectors, cells, seed) if len(drawn) else np.zeros((1, size))
    probes, held = probes_for(vectors, np.array([r["profile"] for r in drawn], dtype=object), centroids, k, recall) if len(drawn) else (1, 1.0)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    facts = (metric, centroids.shape[1], len(centroids), probes, held, chunks.schema["embedding"].dataType.simpleString())
    spark.createDataFrame([facts], "metric string, dimensions int, cells int, probes int, recall double, kind string").write.parquet(f"{path}/facts")
    _write_lists(chunks, path, centroids, metric, 0)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    facts = spark.read.parquet(f"{path}/facts").first()
    return Index(spark, path, facts["metric"], facts["cells"], facts["probes"], facts["kind"])


def add_to_index(index: Index, chunks: DataFrame) -> None:
    """Places further chunks with the same centroids; what lies in the index stays as it is."""
    last = index.sizes.agg(F.max("part")).first()[0]
    _write_lists(chunks, index.path, index.centroids, index.metric, 0 if last is None else last + 1)


def _probing(centroids: np.ndarray, metric: str, probes: int):
    """The cells that each query probes: its nearest ones, and the one of unplaced chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = centroids.shape[1]
        for batch in batches:
            column = batch.column("query_vec")
            usable = np.asarray(pa.compute.list_value_length(column)) == size
            cells: list[list[int]] = [[UNPLACED]] * batch.num_rows
            if usable.any():
                flat = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype("float64")
                order = _squared(_ready(flat.reshape(-1, size), metric), centroids).argsort(axis=1, kind="stable")[:, :probes]
                for i, near in zip(np.flatnonzero(usable).tolist(), order.tolist()):
                    cells[i] = [UNPLACED, *near]
            yield batch.append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    return run


def search_index(index: Index, queries: DataFrame, k: int, probes: int | None = None, max_distance: float | None = None) -> DataFrame:
    """The k nearest chunks per query within its profile, among the probed lists: (query_id, uid, distance, rank).

    ``queries`` has (profile, query_id, query_vec), one row a query id. ``probes`` is by default what the
    index measured; as many as there are cells give the exact answer. Ties go to the smaller uid. Chunks farther than
    ``max_distance`` are left out. A task holds a block of queries while the lists that they probe stream past, so
    neither a query nor its hits are repeated for each list.
    """
    probes = index.probes if probes is None else max(1, min(probes, index.cells))
    lists = index.lists
    asked = queries.select(F.col("profile").cast("string"), F.col("query_id").cast("string").alias("query_id"), "query_vec").where(F.size("query_vec") > 0)
    if probes < index.cells:
        kind = asked.schema["query_vec"].dataType.simpleString()
        asked = asked.mapInArrow(_probing(index.centroids, index.metric, probes), f"profile string, query_id string, query_vec {kind}, cells array<int>")
        # One row per list at most; lists that nobody probes aren't read.
        lists = lists.join(F.broadcast(asked.select(F.explode("cells").alias("cell")).distinct()), "cell", "left_semi")
    return best_hits(_shuffled_hits(lists, asked, k, index.metric, max_distance=max_distance), k, 1)
