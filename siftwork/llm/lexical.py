"""Ranked lexical search of many items at once: what items have in common is added up once a document.

The items of a block form a graph. Its leaves are terms with their number of repeats, an inner node
is the sum of two nodes that several items share, and an item is the sum of the few nodes left of it. A task
fills the leaves for some documents, adds up the inner nodes level by level (the partial
accumulators, each made once) and reads every item's scores off them. It keeps the best rows of each item,
so a task emits ``k`` rows an item however many documents it saw.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.shared import new_folder
from siftwork.llm.worker import texts

BLOCK = 4 << 20  # bytes of item text that are searched in one pass over the documents
WIDTH = 64  # nodes of an item, the most shared ones, that are paired when common sets are mined; decides speed only
CELLS = 4 << 20  # accumulators a task holds at a time
FAN = 64  # tasks whose best rows are merged first
STRIDE = 1 << 20  # bytes of a text that are cut into terms at a time

# ASCII letters and digits and every byte of other characters belong to terms; A-Z become a-z.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

HITS = "query string, doc_id long, score long"


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, some at a time."""
    folded, at = text.encode().translate(FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + STRIDE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(text: str, numbers: dict) -> tuple[int, Counter]:
    """How many terms a text has, and how often each numbered one occurs."""
    found: Counter = Counter()
    for part in terms(text):
        found.update(map(numbers.get, part))
    n = found.total()
    found.pop(None, None)
    return n, found


class Graph:
    """The query-sharing graph of a block: ``numbers`` of terms, leaves, pair sums by level, items.

    ``queries`` are bags of terms. Common sets are mined in rounds: pairs of nodes that stand together in
    most items become a node each, a node taking part in one pair a round, until no pair is in two items.
    """

    def __init__(self, queries: list[Counter]):
        self.numbers = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
        leaves: dict[tuple[int, int], int] = {}
        rows = [{leaves.setdefault((self.numbers[t], n), len(leaves)) for t, n in sorted(q.items())} for q in queries]
        self.leaf_term, self.leaf_times = np.array(list(leaves), np.int64).reshape(-1, 2).T
        self.additions_apart = sum(len(r) for r in rows)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes = len(leaves)
        while pairs := self._common(rows):
            partner = {}
            for number, (a, b) in enumerate(pairs, self.nodes):
                partner[a] = (b, number)
            for row in rows:
                for a in [x for x in row if x in partner]:
                    b, number = partner[a]
                    if b in row:
                        row -= {a, b}
                        row.add(number)
            a, b = np.array(pairs, np.int64).T
            self.levels.append((a, b))
            self.nodes += len(pairs)
        self.members = np.array([x for r in rows for x in sorted(r)], np.int64)
        self.starts = np.cumsum([0, *(len(r) for r in rows)])[:-1].astype(np.int64)
        self.additions = self.nodes - len(leaves) + len(self.members)

    @staticmethod
    def _common(rows: list[set[int]]) -> list[tuple[int, int]]:
        support = Counter(x for r in rows for x in r)
        together: Counter = Counter()
        for row in rows:
            shared = sorted((x for x in row if support[x] > 1), key=lambda x: (-support[x], x))[:WIDTH]
            together.update(combinations(sorted(shared), 2))
        taken: set[int] = set()
        chosen = []
        for pair, n in sorted(together.items(), key=lambda x: (-x[1], x[0])):
            if n > 1 and taken.isdisjoint(pair):
                taken |= set(pair)
                chosen.append(pair)
        return chosen

    def scores(self, per_term: np.ndarray) -> np.ndarray:
        """Scores (items x documents) from what a single occurrence of each term in an item is worth (terms x documents)."""
        sums = np.empty((self.nodes, per_term.shape[1]), np.int64)
        at = len(self.leaf_term)
        np.multiply(per_term[self.leaf_term], self.leaf_times[:, None], out=sums[:at])
        for a, b in self.levels:
            np.add(sums[a], sums[b], out=sums[at : at + len(a)])
            at += len(a)
        return np.add.reduceat(sums[self.members], self.starts, axis=0)


class Best:
    """The ``k`` best documents of each item: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.kept = self._empty()
        self.waiting: list[tuple] = []
        self.size = 0

    @staticmethod
    def _empty() -> tuple:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        self.waiting.append((item, scores[item, at], ids[at], null[at]))
        self.size += len(item)
        if self.size > max(100_000, 4 * self.k * len(self.floor)):
            self.settle()

    def settle(self) -> tuple:
        item, score, ids, null = map(np.concatenate, zip(self.kept, *self.waiting))
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        good = place < self.k
        full = place == self.k - 1
        self.floor[item[full]] = score[full]
        self.kept, self.waiting, self.size = (item[good], score[good], ids[good], null[good]), [], 0
        return self.kept


def _statistics(numbers):
    """Per task: documents that hold each term (its number), documents with a term (-1), all their terms (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value.numbers
        holding, documents, total = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for text in texts(batch):
                n, found = counted(text, known)
                documents, total = documents + (n > 0), total + n
                holding[list(found)] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([documents, total, *holding[at].tolist()], pa.int64())], names=["term", "n"])

    return run


def _search(shared, keys: list[str], documents: int, total: int, k: int):
    """Per task: its best ``k`` documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights = shared.value
        best = Best(len(keys), k)
        width = max(1, CELLS // (graph.nodes + len(graph.members) + len(graph.numbers)))
        for batch in batches:
            ids, null = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for start in range(0, batch.num_rows, width):
                part = texts(batch.slice(start, width))
                at, term, tf, least = [], [], [], []
                for i, text in enumerate(part):
                    n, found = counted(text, graph.numbers)
                    if found:
                        at += [i] * len(found)
                        term += found.keys()
                        tf += found.values()
                        least += [12 * (75 + 25 * n * documents // total)] * len(found)
                if not at:
                    continue
                tf, worth = np.array(tf, np.int64), np.zeros((len(graph.numbers), len(part)), np.int64)
                worth[term, at] = weights[term] * (1_000_000_000 * tf // (1000 * tf + np.array(least, np.int64)))
                best.add(graph.scores(worth), ids[start : start + width], null[start : start + width])
        if best.waiting or len(best.kept[0]):
            item, score, ids, null = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in item], pa.string()), pa.array(ids, mask=null), pa.array(score)], names=["query", "doc_id", "score"])

    return run


def _weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _block_hits(docs: DataFrame, queries: list[tuple[str, Counter]], k: int, path: str) -> None:
    """Appends the best rows of one block of items to the table at ``path``; nothing of the block is kept."""
    spark = docs.sparkSession
    graph = Graph([q for _, q in queries])
    sent = spark.sparkContext.broadcast(graph)
    found = docs.select("text").mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in found.collect()}  # one row a term of the block, and two
    sent.destroy()
    documents, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([_weight(documents, counts.get(i, 0)) for i in range(len(graph.numbers))], np.int64)
    sent = spark.sparkContext.broadcast((graph, weights))
    rows = docs.mapInArrow(_search(sent, [key for key, _ in queries], documents, total, k), HITS)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("query", "task").orderBy(*order)
    rows = rows.withColumn("task", F.floor(F.spark_partition_id() / FAN)).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    rows.drop("task").write.mode("append").parquet(path)
    sent.destroy()


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs`` for every row of ``items``.

    Equal scores rank by ascending ``doc_id``, a null id last. Repeated documents are documents of their own,
    equal items are searched once and answered as often as they occur, also with a null ``item_id``. A null or
    empty text has no terms: such a document scores nothing and isn't counted, such an item has no rows.
    Only scores above 0 count. Empty tables give an empty result. Other columns are not read. Items are searched
    in blocks of some ``BLOCK`` bytes of text, with two scans of the documents each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select("item_id", F.col("text").cast("string"))
    asked = items.where(F.length("text") > 0).withColumn("query", F.sha2("text", 256))
    distinct = asked.select("query", "text").distinct()
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = new_folder(spark, "ranked")
    schema = f"{HITS}, rank int"
    spark.createDataFrame([], schema).write.parquet(path)
    blocks = -(-size // BLOCK)
    for block in range(blocks):
        # Some BLOCK bytes of distinct items.
        rows = distinct.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
        bags = [(r["query"], sum(map(Counter, terms(r["text"])), Counter())) for r in sorted(rows)]
        if queries := [(key, bag) for key, bag in bags if bag]:
            _block_hits(docs, queries, k, path)
    return asked.join(spark.read.schema(schema).parquet(path), "query").select("item_id", "rank", "doc_id", "score")
