"""Token ids of all documents as binary files in ascending ``doc_id`` order, and their reader.

A range partition of ``doc_id`` becomes one file, so the files in order are the corpus in order.
A file is a sequence of blocks of whole documents (``BLOCK`` ids or one document more); each row
carries what a reader needs without unpacking: the documents' ids and numbers of tokens, the ids
of the file before the block, and the Simple-8b payload. Files are written by Spark's own writer,
so they may lie in any store that Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm import simple8b
from siftwork.llm.tokens import encoder
from siftwork.llm.worker import slices, texts

BLOCK = 1 << 16
SLICE = 6 << 20  # bytes of text, or of payloads, that a worker has as Python objects at a time
KEPT = 500_000  # items whose ids a worker keeps, twice as many at most and some 50 MB in all

FORMAT = "part int, block int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, dealt into ranges of ``doc_id`` and sorted; equal ids by text, null first."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def encode_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """The rows of the files: every text's ids by the tokenizer file ``path``, then ``end_id``.

    A null text counts as empty (the end id alone); a null ``doc_id`` is kept and comes first;
    repeated rows stay; an empty table gives no block; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path, KEPT), TaskContext.get().partitionId()
        block, first = 0, 0
        doc_ids, sizes, ids, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            columns = [[part], [block], [first], [held], [doc_ids], [sizes], [simple8b.encode(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "block", "first", "n_tokens", "doc_ids", "doc_tokens", "payload"])

        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                found, at = own.encode(texts(piece))
                for i, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                    ids += [found[at[i] : at[i + 1]], np.array([end_id], "<u4")]
                    size = int(at[i + 1] - at[i]) + 1
                    doc_ids.append(doc_id)
                    sizes.append(size)
                    held += size
                    if held >= BLOCK:
                        yield row()
                        block, first = block + 1, first + held
                        doc_ids, sizes, ids, held = [], [], [], 0
        if doc_ids:
            yield row()

    return in_order(docs).mapInArrow(run, FORMAT)


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> None:
    """Writes the files into ``folder``; the payload is packed already, so it isn't compressed again."""
    encode_files(docs, path, end_id).write.option("compression", "none").parquet(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of the files, each with ``base``: the ids of all files before its own.

    The totals of the files are one row per file, so their running sum is a small table whatever
    the size of the corpus, and it may be broadcast.
    """
    blocks = spark.read.schema(FORMAT).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "part")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for piece in slices(batch, "payload", SLICE):
        yield from piece.to_pylist()


def digests(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the unpacked payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids = simple8b.decode(row["payload"]).astype("<u4")
                sizes = np.array(row["doc_tokens"])
                starts = np.cumsum(sizes) - sizes
                sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"] + row["base"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_of(blocks: DataFrame) -> DataFrame:
    """``doc_id, ids``: the ids of every document, unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids = simple8b.decode(row["payload"]).astype(np.int64)
                ends = np.cumsum([0, *row["doc_tokens"]])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([ids[a:b] for a, b in zip(ends, ends[1:])], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<long>")
