"""Vector top-k of chunks per query, rolled up to postings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions import vectors as V
from siftwork.functions.strings import round4

# Queries up to this many rows are shipped to every task; more are matched by shuffle.
BROADCAST_QUERIES = 4096
# Hits up to this many rows (some 20 MB) are broadcast when their fields are fetched.
BROADCAST_HITS = 200_000
# Queries whose distances to one batch of chunks are held at a time.
DISTANCE_BLOCK = 256
# Queries that a task holds while the chunks of its slice stream past, and the hits it holds for them: a larger k has
# fewer queries in a task.
HELD_QUERIES = 16_384
HELD_HITS = 1_000_000
# Chunks of one slice, which stream past; fewer where that would be more distances in one task than SLICE_DISTANCES.
SLICE_ROWS = 400_000
LEAST_SLICE_ROWS = 20_000
SLICE_DISTANCES = 5_000_000_000
# A profile in more slices than this has its queries bounded by a first pass.
FREE_SLICES = 4
# Queries and chunks of one product, which stays in a core's cache.
QUERY_BLOCK = 256
CHUNK_BLOCK = 2048
# Queries of one block where each looks at some cells only, and chunks that are looked at together.
CELL_QUERY_BLOCK = 4096
SEEN_ROWS = 32_768
# Pairs whose distances are taken at a time.
PAIR_BLOCK = 16_384
# One chunk in this many is looked at first: the k-th distance among them bounds the k-th of all.
BOUND_EVERY = 64
# What rounding may differ by between two passes over the same vectors.
BOUND_SLACK = 2 * 10.0**-V.DISTANCE_DECIMALS
# Parts of a query's hits that are cut to k rows before they meet.
MERGE_PARTS = 16
# Parts of a profile when its rows meet their number of slices.
SALTS = 32

HITS = "query_id string, uid string, distance double"


def _distances(chunks: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """chunks x queries, in double precision, rounded so that equal vectors tie."""
    dots = chunks @ queries.T
    if metric == "cosine":
        norms = np.linalg.norm(chunks, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1.0 - dots / norms
    else:
        out = (chunks**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2.0 * dots
    return np.round(np.nan_to_num(out, nan=1.0), V.DISTANCE_DECIMALS) + 0.0


class _TopK:
    """Best k (distance, uid) per query over the blocks one task sees; ties go to the smaller uid.

    ``bounds`` are distances beyond which a query needs no chunk.
    """

    def __init__(self, query_ids: list[str], queries: np.ndarray, k: int, metric: str, bounds: np.ndarray | None = None) -> None:
        self.query_ids, self.queries, self.k, self.metric = query_ids, queries, k, metric
        self.bounds = np.full(len(query_ids), np.inf) if bounds is None else bounds
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(query_ids)

    def add(self, uids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(uids) or vectors.shape[1] != self.queries.shape[1]:
            return
        for start in range(0, len(self.query_ids), DISTANCE_BLOCK):
            distances = _distances(vectors, self.queries[start : start + DISTANCE_BLOCK], self.metric)
            near = distances <= self.bounds[start : start + DISTANCE_BLOCK]
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                self._merge(start + j, distances[near[:, j], j], uids[near[:, j]])

    def _merge(self, j: int, d: np.ndarray, uids: np.ndarray) -> None:
        held = self.best[j]
        if held is not None:
            if len(held[0]) == self.k:
                near = d <= held[0][-1]
                d, uids = d[near], uids[near]
                if not len(d):
                    return
            d, uids = np.concatenate([held[0], d]), np.concatenate([held[1], uids])
        if len(d) > self.k:
            limit = np.partition(d, self.k - 1)[self.k - 1]
            near = d <= limit
            d, uids = d[near], uids[near]
        order = np.lexsort((uids, d))[: self.k]
        self.best[j] = (d[order], uids[order])

    def rows(self) -> Iterator[tuple[str, str, float]]:
        for query_id, held in zip(self.query_ids, self.best):
            if held is not None:
                for distance, uid in zip(*held):
                    yield query_id, uid, float(distance)


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int, dtype: str = "float64") -> tuple[np.ndarray, np.ndarray]:
    """(row mask, matrix) of the list rows that have the wanted length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    usable = lengths == dimensions
    flat = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
    return usable, flat.astype(dtype).reshape(-1, dimensions)


def _pair_distances(chunks: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Row by row what ``_distances`` gives for all pairs."""
    x, y = chunks.astype("float64"), queries.astype("float64")
    dots, xx, yy = (np.einsum("ij,ij->i", a, b) for a, b in ((x, y), (x, x), (y, y)))
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1.0 - dots / (np.sqrt(xx) * np.sqrt(yy))
    else:
        out = xx + yy - 2.0 * dots
    return np.round(np.nan_to_num(out, nan=1.0), V.DISTANCE_DECIMALS) + 0.0


class _Single:
    """Vectors in single precision, made so that a product of two of them tells which pairs cannot be near.

    Cosine: directions, and the product is the likeness. Else the product of (x, -xx/2) and (y, 1) is (yy - distance) / 2.
    Vectors too long, too short or not finite for that are not ``safe``: all their pairs are looked at.
    """

    def __init__(self, vectors: np.ndarray, metric: str, query: bool) -> None:
        wide = vectors.astype("float64")
        with np.errstate(all="ignore"):
            squared = np.einsum("ij,ij->i", wide, wide)
            self.safe = bool(((squared == 0) | ((squared > 1e-24) & (squared < 1e24))).all())
            self.longest = float(np.sqrt(squared.max(initial=0.0))) if self.safe else 0.0
            self.squared = squared
            if metric == "cosine":
                wide = np.divide(wide, np.sqrt(squared)[:, None], out=np.zeros_like(wide), where=squared[:, None] > 0)
            else:
                wide = np.column_stack([wide, np.ones(len(wide)) if query else -squared / 2.0])
            self.rows = wide.astype("float32")

    def least_product(self, which: slice | np.ndarray, limits: np.ndarray, chunks: "_Single", metric: str) -> np.ndarray:
        """For these queries the product below which a chunk is farther than their limit, whatever was lost in rounding."""
        error = (self.rows.shape[1] + 8) * 2.0**-22
        if metric == "cosine":
            return (1.0 - limits - error - BOUND_SLACK).astype("float32")
        squared = self.squared[which]
        scale = (np.sqrt(squared) + chunks.longest) ** 2
        return ((squared - limits - BOUND_SLACK) / 2.0 - error * scale).astype("float32")


class _HeldQueries:
    """Some queries of one vector length and their k nearest among the chunks that have passed.

    Chunks are known by their number in the stream, which ascends with their uid, so ties go to the smaller uid. Only
    pairs that single precision cannot rule out get a distance; the limit is the k-th distance so far.
    """

    def __init__(self, ids: list[str], vectors: np.ndarray, limits: np.ndarray, k: int, metric: str) -> None:
        self.ids, self.vectors, self.limits, self.k, self.metric = ids, vectors, limits.copy(), k, metric
        self.single = _Single(vectors, metric, query=True)
        self.best = (np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_new = 0

    def add(self, numbers: np.ndarray, vectors: np.ndarray, single: _Single, asked: np.ndarray | None = None) -> None:
        """Chunks of the same length, all after those before; ``asked`` are the queries that look at them."""
        which = slice(None) if asked is None else asked
        rows, start = self.single.rows[which], 0
        while start < len(numbers):
            limits = self.limits[which]
            # Until every query has a limit all pairs are looked at, so few at a time.
            stop = start + (CHUNK_BLOCK if np.isfinite(limits).all() else max(128, 2 * self.k))
            if self.single.safe and single.safe:
                least = self.single.least_product(which, limits, single, self.metric)
                q, c = np.nonzero(rows @ single.rows[start:stop].T >= least[:, None])
            else:
                q, c = (x.ravel() for x in np.indices((len(limits), len(numbers[start:stop]))))
            q = q if asked is None else asked[q]
            for first in range(0, len(q), PAIR_BLOCK):
                some, of = q[first : first + PAIR_BLOCK], c[first : first + PAIR_BLOCK] + start
                distances = _pair_distances(vectors[of], self.vectors[some], self.metric)
                near = distances <= self.limits[some]
                self.new.append((some[near].astype(np.uint16), distances[near], numbers[of[near]]))
                self.n_new += int(near.sum())
            if self.n_new >= max(1024, len(self.ids) * self.k // 2):
                self.cut()
            start = stop

    def cut(self) -> None:
        q, d, number = (np.concatenate(x) for x in zip(self.best, *self.new))
        self.new, self.n_new = [], 0
        # Both sorts keep the order of equals, and every part has a query's chunks in the order of their numbers.
        order = np.argsort(d, kind="stable")
        order = order[np.argsort(q[order], kind="stable")]
        q, d, number = q[order], d[order], number[order]
        starts = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - starts[q]
        last = rank == self.k - 1
        self.limits[q[last]] = np.minimum(self.limits[q[last]], d[last])
        keep = rank < self.k
        self.best = q[keep], d[keep], number[keep]

    def hits(self, uids: pa.Array) -> pa.RecordBatch | None:
        self.cut()
        q, d, number = self.best
        if not len(q):
            return None
        ids = pa.array(self.ids, pa.string()).take(pa.array(q))
        return pa.RecordBatch.from_arrays([ids, uids.take(pa.array(number)), pa.array(d)], names=["query_id", "uid", "distance"])


class _Group:
    """Queries of one group, held in blocks, and the chunks that stream past them."""

    def __init__(self, k: int, metric: str, kind: str) -> None:
        self.k, self.metric, self.kind = k, metric, kind
        # Blocks by vector length; of each block the queries that look at a cell.
        self.blocks: dict[int, list[tuple[_HeldQueries, dict[int, np.ndarray] | None]]] = {}
        self.waiting: list[pa.RecordBatch] = []
        self.seen: list[pa.RecordBatch] = []
        self.n_seen, self.passed, self.uids = 0, 0, []

    def hold(self, rows: pa.RecordBatch) -> None:
        self.waiting.append(rows)

    def _settle(self) -> None:
        """Queries come in batches of any size, so blocks are made when all are there."""
        rows, self.waiting = pa.Table.from_batches(self.waiting).combine_chunks(), []
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(rows.column("vec")), 0))
        for size in sorted(set(sizes.tolist()) - {0}):
            at = np.flatnonzero(sizes == size)
            step = CELL_QUERY_BLOCK if "cells" in rows.column_names else QUERY_BLOCK
            for first in range(0, len(at), step):
                block = rows.take(pa.array(at[first : first + step]))
                vectors = _matrix(block.column("vec"), size, self.kind)[1]
                limits = np.asarray(block.column("bound").fill_null(np.inf)).astype("float64")
                cells = None
                if "cells" in block.column_names:
                    lists = block.column("cells").combine_chunks()
                    flat, which = np.asarray(lists.flatten()), np.asarray(pa.compute.list_parent_indices(lists))
                    order = np.argsort(flat, kind="stable")
                    names, starts = np.unique(flat[order], return_index=True)
                    cells = dict(zip(names.tolist(), np.split(which[order], starts[1:])))
                held = _HeldQueries(block.column("id").to_pylist(), vectors, limits, self.k, self.metric)
                self.blocks.setdefault(size, []).append((held, cells))

    def see(self, rows: pa.RecordBatch) -> None:
        if self.waiting:
            self._settle()
        if self.blocks:
            self.seen.append(rows)
            self.n_seen += rows.num_rows
            if self.n_seen >= SEEN_ROWS:
                self._look()

    def _look(self) -> None:
        rows = pa.Table.from_batches(self.seen).combine_chunks().to_batches()[0]
        self.seen, self.n_seen = [], 0
        # A copy: a slice would keep the whole batch.
        self.uids.append(rows.column("id").take(pa.array(np.arange(rows.num_rows))))
        numbers = self.passed + np.arange(rows.num_rows)
        self.passed += rows.num_rows
        for size, blocks in self.blocks.items():
            usable, vectors = _matrix(rows.column("vec"), size, self.kind)
            if not len(vectors):
                continue
            own = numbers[usable]
            if blocks[0][1] is None:
                single = _Single(vectors, self.metric, query=False)
                for held, _ in blocks:
                    held.add(own, vectors, single)
                continue
            cells = np.asarray(rows.column("cell"))[usable]
            order = np.argsort(cells, kind="stable")
            names, starts = np.unique(cells[order], return_index=True)
            for name, at in zip(names.tolist(), np.split(order, starts[1:])):
                single = _Single(vectors[at], self.metric, query=False)
                for held, asking in blocks:
                    if name in asking:
                        held.add(own[at], vectors[at], single, asking[name])

    def hits(self) -> Iterator[pa.RecordBatch]:
        if self.seen:
            self._look()
        if not self.passed:
            return
        uids = pa.concat_arrays(self.uids)
        for blocks in self.blocks.values():
            for held, _ in blocks:
                found = held.hits(uids)
                if found is not None:
                    yield found


def _as_batch(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    ids, uids, distances = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), pa.array(uids, pa.string()), pa.array(distances, pa.float64())],
        names=["query_id", "uid", "distance"],
    )


def _broadcast_hits(chunks: DataFrame, queries: list[Any], k: int, metric: str, bounds: dict[str, float] | None = None) -> DataFrame:
    """Scan the chunks once where they lie; at most k rows per query leave a task, and none beyond the query's bound."""
    by_profile: dict[str, tuple[list[str], list[np.ndarray]]] = {}
    for row in queries:
        ids, vectors = by_profile.setdefault(row["profile"], ([], []))
        ids.append(row["query_id"])
        vectors.append(np.asarray(row["query_vec"], dtype="float64"))
    # One block per profile and vector length.
    blocks: dict[str, list[tuple[list[str], np.ndarray, np.ndarray]]] = {}
    for profile, (ids, vectors) in by_profile.items():
        for size in sorted({len(v) for v in vectors}):
            same = [i for i, v in enumerate(vectors) if len(v) == size]
            limits = np.array([(bounds or {}).get(ids[i], np.inf) for i in same])
            blocks.setdefault(profile, []).append(([ids[i] for i in same], np.stack([vectors[i] for i in same]), limits))
    shared = chunks.sparkSession.sparkContext.broadcast(blocks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {p: [_TopK(ids, m, k, metric, limits) for ids, m, limits in blocks] for p, blocks in shared.value.items()}
        for batch in batches:
            profiles = np.asarray(batch.column("profile").to_pylist(), dtype=object)
            uids = np.asarray(batch.column("uid").to_pylist(), dtype=object)
            for profile in set(profiles.tolist()) & set(tops):
                mine = profiles == profile
                part = batch.column("embedding").filter(pa.array(mine))
                for top in tops[profile]:
                    usable, vectors = _matrix(part, top.queries.shape[1])
                    top.add(uids[mine][usable], vectors)
        for blocks_of_profile in tops.values():
            for top in blocks_of_profile:
                rows = list(top.rows())
                if rows:
                    yield _as_batch(rows)

    # Only profiles that are asked for are read.
    wanted = chunks.where(F.col("profile").isin(sorted(blocks))) if len(blocks) <= 200 else chunks
    return wanted.select("profile", "uid", "embedding").mapInArrow(scan, HITS)


def best_hits(hits: DataFrame, k: int, parts: int = MERGE_PARTS) -> DataFrame:
    """The k nearest of each query's hits with their ``rank``; many hits of a query are cut in ``parts`` first."""
    near = [F.col("distance"), F.col("uid")]
    if parts > 1:
        part = Window.partitionBy("query_id", F.pmod(F.xxhash64("uid"), F.lit(parts))).orderBy(*near)
        hits = hits.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*near))).where(F.col("rank") <= k)


def _every(chunks: DataFrame, n: int) -> DataFrame:
    """One chunk in ``n``, whichever way the rows lie, brought together into few tasks."""
    return chunks.select("profile", "uid", "embedding").where(F.pmod(F.xxhash64("uid", F.lit("bound")), F.lit(n)) == 0).repartition("uid")


def kth_distances(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, bound): no chunk beyond it can be among the k nearest. Queries with fewer hits have no bound."""
    return best_hits(hits, k).where(F.col("rank") == k).select("query_id", (F.col("distance") + BOUND_SLACK).alias("bound"))


def streamed_hits(chunks: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Hits of queries among the chunks of the same ``grp``: (query_id, uid, distance), at most k a query and group.

    ``chunks`` has (grp, uid, embedding), ``queries`` (grp, query_id, query_vec, bound). Both go to the task of their
    group, queries first: a task holds the queries of one group, whose number the caller bounds, and their hits, and the
    chunks stream past them in the order of their uids. With ``cell`` on the chunks and ``cells`` on the queries, a query
    looks only at chunks of its cells.
    """
    left, right = chunks.schema["embedding"].dataType, queries.schema["query_vec"].dataType
    single = left == right and left.simpleString() == "array<float>"
    kind, dtype = ("array<float>", "float32") if single else ("array<double>", "float64")
    own, asked = [], []
    if "cells" in queries.columns:
        own = [F.col("cell"), F.lit(None).cast("array<int>").alias("cells")]
        asked = [F.lit(None).cast("int").alias("cell"), F.col("cells")]
    none = F.lit(None).cast("double")
    sides = chunks.select("grp", F.lit(1).alias("side"), F.col("uid").alias("id"), F.col("embedding").cast(kind).alias("vec"), none.alias("bound"), *own)
    sides = sides.unionByName(queries.select("grp", F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("query_vec").cast(kind).alias("vec"), F.col("bound"), *asked))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, group = None, None
        for batch in batches:
            runs = pa.compute.run_end_encode(batch.column("grp"))
            start = 0
            for stop, other in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if group is None or other != name:
                    if group is not None:
                        yield from group.hits()
                    name, group = other, _Group(k, metric, dtype)
                rows = batch.slice(start, stop - start)
                start = stop
                middle = int(np.searchsorted(rows.column("side").to_numpy(), 1))
                if middle:
                    group.hold(rows.slice(0, middle))
                if middle < rows.num_rows:
                    group.see(rows.slice(middle))
        if group is not None:
            yield from group.hits()

    return sides.repartition("grp").sortWithinPartitions("grp", "side", "id").mapInArrow(scan, HITS)


def _sliced(rows: DataFrame, sizes: DataFrame, key: Column, on: list[str]) -> DataFrame:
    """Rows with the sizes of their profile. A profile with a third of all rows meets them in ``SALTS`` parts."""
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash(key), F.lit(SALTS))).join(salted, [*on, "salt"]).drop("salt")


def _sizes(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(profile, n_slices, n_blocks): how many parts of a profile's chunks and queries meet, each with each."""
    most = max(1, min(HELD_QUERIES, HELD_HITS // k))
    asked = queries.groupBy("profile").agg(F.count("*").alias("q"))
    rows = F.least(F.lit(SLICE_ROWS), F.greatest(F.lit(LEAST_SLICE_ROWS), F.floor(F.lit(SLICE_DISTANCES) / F.least("q", F.lit(most)))))
    both = chunks.groupBy("profile").agg(F.count("*").alias("n")).join(asked, "profile")
    return both.select("profile", F.ceil(F.col("n") / rows).alias("n_slices"), F.ceil(F.col("q") / F.lit(most)).alias("n_blocks"))


def _shuffled_hits(chunks: DataFrame, queries: DataFrame, k: int, metric: str, bounds: DataFrame | None = None, max_distance: float | None = None) -> DataFrame:
    """Profiles cut into slices of their chunks and blocks of their queries, so that no task holds a whole profile.

    Slices and blocks are sized from counts per profile; a query goes to every slice of its profile, a chunk to every
    block. With ``cell`` on the chunks and ``cells`` on the queries, a chunk goes to the blocks that look at its cell.
    """
    sizes, limit = _sizes(chunks, queries, k), F.lit(max_distance).cast("double")
    own, asked, on = ([], [], ["profile"]) if "cells" not in queries.columns else (["cell"], ["cells"], ["profile", "cell"])
    right = _sliced(queries.select("profile", "query_id", "query_vec", *asked), sizes, F.col("query_id"), ["profile"])
    right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("n_blocks")))
    blocks = sizes.select("profile", "n_slices", F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1).alias("blocks"))
    if own:
        blocks = right.select("profile", "n_slices", "block", F.explode("cells").alias("cell")).groupBy("profile", "cell", "n_slices").agg(F.collect_set("block").alias("blocks"))
    left = _sliced(chunks.select("profile", "uid", "embedding", *own), blocks, F.col("uid"), on)
    left = left.withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("n_slices"))).withColumn("block", F.explode("blocks"))
    right = right.withColumn("bound", limit) if bounds is None else right.join(bounds, "query_id", "left")
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_slices") - 1)))
    group = F.concat_ws("/", "block", "slice", "profile").alias("grp")
    return streamed_hits(left.select(group, "uid", "embedding", *own), right.select(group, "query_id", "query_vec", "bound", *asked), k, metric)


def most_slices(chunks: DataFrame, queries: DataFrame, k: int) -> int:
    """The most slices that a profile's chunks are cut into for these queries."""
    return _sizes(chunks, queries, k).agg(F.max("n_slices")).first()[0] or 0


def nearest(
    chunks: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", broadcast_queries: int = BROADCAST_QUERIES,
    bound_every: int | None = BOUND_EVERY,
) -> DataFrame:
    """Exact k nearest chunks per query within its profile: (query_id, uid, distance, rank).

    ``chunks`` has (profile, uid, embedding), ``queries`` (profile, query_id, query_vec).
    No pair of chunk and query is ever a row. At most ``broadcast_queries`` + 1 query rows
    are read on the driver to decide how to run; more queries than that go by shuffle.

    One chunk in ``bound_every`` is searched first: a query's k-th distance there bounds its k-th distance among all
    chunks, so the search itself passes on some ``k * bound_every`` rows a query however many tasks it has, instead of k
    a task. A query with fewer than k chunks in that part goes without; its profile has not many more than that. None
    leaves the first pass out, and so does a search by shuffle that cuts no profile into more than ``FREE_SLICES``.
    """
    return _nearest(chunks, queries, k, metric, broadcast_queries, bound_every)[0]


def _nearest(
    chunks: DataFrame, queries: DataFrame, k: int, metric: str, broadcast_queries: int, bound_every: int | None = BOUND_EVERY
) -> tuple[DataFrame, int | None]:
    """The hits and, when the queries were counted, a bound on their number."""
    if metric not in V.METRICS:
        raise ValueError(f"metric must be one of {V.METRICS}")
    hits, bound = _all_hits(chunks, queries, k, metric, broadcast_queries, bound_every)
    # By shuffle a query has k hits a slice at most.
    return best_hits(hits, k, MERGE_PARTS if bound is not None else 1), bound


def _all_hits(
    chunks: DataFrame, queries: DataFrame, k: int, metric: str, broadcast_queries: int, bound_every: int | None
) -> tuple[DataFrame, int | None]:
    """What leaves the tasks of a search, before a query's hits meet."""
    asked = queries.select("profile", F.col("query_id").cast("string").alias("query_id"), "query_vec")
    asked = asked.where(F.size("query_vec") > 0)
    chunks = chunks.where(F.size("embedding") > 0)
    head = asked.limit(broadcast_queries + 1).collect()
    if len(head) > broadcast_queries:
        bounds = None
        if bound_every and most_slices(chunks, asked, k) > FREE_SLICES:
            bounds = kth_distances(_shuffled_hits(_every(chunks, bound_every), asked, k, metric), k)
        return _shuffled_hits(chunks, asked, k, metric, bounds), None
    bounds = None
    if bound_every:
        # At most one row a query.
        bounds = {r["query_id"]: r["bound"] for r in kth_distances(_broadcast_hits(_every(chunks, bound_every), head, k, metric), k).collect()}
    return _broadcast_hits(chunks, head, k, metric, bounds), len(head) * k


def metadata_filter(chunks: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """Equality filters on chunk fields, applied before the top-k."""
    for name, value in (filters or {}).items():
        chunks = chunks.where(F.col(name) == F.lit(value))
    return chunks


def similarity_floor(hits: DataFrame, floor: float = vocab.SIMILARITY_FLOOR) -> DataFrame:
    return hits.where(F.col("similarity") >= floor)


def similar_chunks(
    chunks: DataFrame, queries: DataFrame, k: int | None = None, filters: dict[str, Any] | None = None,
    metric: str = "cosine", broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """The k most similar chunks per query with their fields, floor applied after the top-k.

    The search reads ids and vectors only; texts and titles are fetched for the winners.
    """
    k = V.clamp_k(k, vocab.TOP_CHUNKS, vocab.TOP_CHUNKS_MAX)
    pool = metadata_filter(chunks, filters)
    found, bound = _nearest(pool, queries, k, metric, broadcast_queries)
    scored = similarity_floor(found.withColumn("similarity", V.similarity(F.col("distance"))))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "profile", "query_text")
    fields = [c for c in pool.columns if c not in ("embedding",)]
    hits = scored.join(asked, "query_id")
    if bound is not None and bound <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return pool.select(*fields).join(hits, ["profile", "uid"])


def _job_rows(hits: DataFrame, texts: bool) -> DataFrame:
    """One row per (query, posting) with its hits, most similar first, and the fields of the first."""
    weight = V.retrieval_weight(F.col("chunk_key"), F.col("query_text"))
    weighted = round4(F.least(F.lit(1.0), F.col("similarity") * weight))
    hit = F.struct(
        "rank", "chunk_key", "chunk_order", "uid", "similarity", weighted.alias("weighted_similarity"), *(["chunk_text"] if texts else []),
    )
    # What belongs to the posting is kept once, not with each hit; fields that nobody reads don't move.
    posting = [F.min_by(c, F.struct("rank", "uid")).alias(c) for c in ("title", "company", "source", "url")]
    # A query keeps at most 200 hits, so the arrays are small and a query fits one partition;
    # partitioned by query, this and all later steps per query need no further shuffle.
    return hits.repartition("query_id").groupBy("profile", "query_id", "job_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"), *posting)


def mean_of_first(values: Column, n: int = 3) -> Column:
    first = F.slice(values, 1, n)
    return F.aggregate(first, F.lit(0.0), lambda s, x: s + x) / F.size(first)


def roll_up(hits: DataFrame, texts: bool = True) -> DataFrame:
    """Hits to postings: best, average of three and section coverage in one aggregate score.

    ``hits`` stays as an array column, so that reranking needs no second pass over the search; without ``texts`` it has
    no ``chunk_text``, which is most of what a hit weighs.
    """
    rows = _job_rows(hits, texts)
    weighted = F.transform("hits", lambda h: h["weighted_similarity"])
    sections = F.transform(F.slice("hits", 1, 3), lambda h: h["chunk_key"])
    coverage = F.least(F.size(F.array_distinct(sections)) / F.lit(3.0), F.lit(1.0))
    aggregate = F.least(
        F.lit(1.0), F.get(weighted, F.lit(0)) * 0.75 + mean_of_first(weighted) * 0.20 + coverage * 0.05
    )
    top = F.get("hits", F.lit(0))
    return rows.select(
        "profile", "query_id", "job_id", "title", "company", "source", "url",
        round4(top["similarity"]).alias("best_similarity"),
        round4(aggregate).alias("aggregate_score"),
        sections.alias("matched_chunks"),
        F.transform(
            F.slice("hits", 1, 5),
            lambda h: F.struct(
                h["chunk_key"].alias("chunk_key"), h["chunk_order"].alias("chunk_order"),
                round4(h["similarity"]).alias("similarity"), h["weighted_similarity"].alias("weighted_similarity"),
            ),
        ).alias("chunk_scores"),
        V.retrieval_reason(sections).alias("retrieval_reason"),
        "hits",
    )


def top_jobs_per_query(jobs: DataFrame, k: int | None = None) -> DataFrame:
    k = V.clamp_k(k, vocab.TOP_JOBS, vocab.TOP_JOBS_MAX)
    order = Window.partitionBy("query_id").orderBy(F.desc("aggregate_score"), F.desc("best_similarity"), "job_id")
    return jobs.withColumn("job_rank", F.row_number().over(order)).where(F.col("job_rank") <= k)


def similar_jobs(
    chunks: DataFrame, queries: DataFrame, k_chunks: int | None = None, k_jobs: int | None = None,
    filters: dict[str, Any] | None = None, metric: str = "cosine",
) -> DataFrame:
    """The best postings per query."""
    hits = similar_chunks(chunks, queries, k_chunks, filters, metric)
    return top_jobs_per_query(roll_up(hits, texts=False), k_jobs).drop("hits")
