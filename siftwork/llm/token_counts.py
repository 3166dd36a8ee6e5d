"""Token counts per document by a map-side lookup of two tiers; no item of text is ever shuffled.

Tier one is a compact table of the items (a word with the blank before it) that are frequent in
the whole corpus, with their numbers of ids: bounded by ``frequent`` entries, so it is broadcast.
It comes from one summary per task over all texts, each bounded, which are merged in rounds of
``FAN`` summaries until one is left. Tier two is the bounded cache of each worker, in which an
item that is not in the table is encoded once by the tokenizer's library. The table decides only
what is fast; counts are exact for every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.shared import stored
from siftwork.llm.tokens import encoder
from siftwork.llm.worker import slices, texts

FAN = 32  # summaries merged by one task
FREQUENT = 32_768  # entries of the broadcast table, about 1 MB

SUMMARY = "part long, items array<string>, counts array<long>"


def _summaries(frequent: int):
    """One row per task: its most frequent items. Rare ones are dropped whenever a summary is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                flat = pc.split_pattern(part.column("text").cast(pa.large_string()).drop_null(), " ").flatten()
                seen = flat.dictionary_encode()
                counts = np.bincount(seen.indices.to_numpy(), minlength=len(seen.dictionary))
                # An item seen once in 8 MB is not frequent; two are the least that count.
                often = np.flatnonzero(counts > 1)
                found.update(dict(zip(seen.dictionary.take(pa.array(often)).to_numpy(zero_copy_only=False).tolist(), counts[often].tolist())))
                if len(found) > 8 * frequent:
                    found = Counter(dict(found.most_common(4 * frequent)))
        top = found.most_common(2 * frequent)
        yield _row(TaskContext.get().partitionId(), top)

    return run


def _row(part: int, top: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[v for _, v in top]], pa.list_(pa.int64()))],
        names=["part", "items", "counts"],
    )


def _merging(frequent: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found: Counter = Counter()
        for items, counts in zip(rows.column("items").to_pylist(), rows.column("counts").to_pylist()):
            found.update(dict(zip(items, counts)))
        # Ties by the item itself, so that the table is the same however the rows arrive.
        top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[: 2 * frequent]
        return pa.Table.from_batches([_row(key[0].as_py(), top)])

    return run


def frequent_items(docs: DataFrame, path: str, frequent: int = FREQUENT) -> dict[str, int]:
    """The ``frequent`` most common items over all texts, with their numbers of ids."""
    summaries = stored(docs.select("text").mapInArrow(_summaries(frequent), SUMMARY), "summaries")
    left = summaries.count()
    while left > 1:
        left = -(-left // FAN)
        summaries = summaries.withColumn("part", F.col("part") % left).groupBy("part").applyInArrow(_merging(frequent), SUMMARY)
    rows = summaries.collect()  # one row of at most 2 * frequent items
    items = [x for row in rows for x in row["items"]][:frequent]
    own = encoder(path)
    made = own._made(items)
    return {k: len(v) // 4 for k, v in zip(items, made) if v is not None}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit); a null ``doc_id`` stays
    null; repeated rows give repeated rows; an empty table gives an empty one; other columns are
    not read. ``path`` names the tokenizer file, ``limit`` the tokens above which ``over_limit`` is set.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_items(docs, path, frequent) if encoder(path).cached else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, common = encoder(path), table.value
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                n = own.lengths(texts(part), common)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
