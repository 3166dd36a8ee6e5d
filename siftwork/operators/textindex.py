"""Full-text search by an index of trigrams: candidates from their lists, ``contains`` as the confirmation.

The index is written where the texts are read, without a shuffle. Rows form blocks; a block has a row with the keys of
its members, and for each trigram that stands in it a row with the places of the members that have it. Rows of a
block are sorted by trigram and lie in one file, written by one task, so a filter on trigrams skips almost all pages. A
search counts the members per trigram, takes the rarest few, intersects their lists within each block and looks the
text up in the candidates only. The answer is that of a scan: a text that contains the wanted words has all their
trigrams. Words of fewer than three characters have none and are scanned for.
"""

from __future__ import annotations

import functools
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.strings import text_of

BLOCK_CHARS = 2_000_000  # characters of a block, about; one text at least
RAREST = 3  # lists that a search intersects
BETWEEN = "\x01"  # stands between two indexed columns

LISTS = "block string, gram string, n int, places array<int>, members array<array<string>>"


def _searched(columns: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(BETWEEN, *[text_of(F.col(c).cast("string")) for c in columns]))


def _block(texts: list[str], members: list[list[str]]) -> pa.RecordBatch:
    """The rows of one block: its members under the empty trigram, then the lists in the order of trigrams."""
    lists: dict[str, list[int]] = defaultdict(list)
    for place, text in enumerate(texts):
        for gram in {text[i : i + 3] for i in range(len(text) - 2)}:
            lists[gram].append(place)
    grams = sorted(lists)
    name = uuid.uuid4().hex
    columns = [
        pa.array([name] * (len(grams) + 1)), pa.array(["", *grams], pa.string()), pa.array([0, *(len(lists[g]) for g in grams)], pa.int32()),
        pa.array([None, *(lists[g] for g in grams)], pa.list_(pa.int32())), pa.array([members, *[None] * len(grams)], pa.list_(pa.list_(pa.string()))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "gram", "n", "places", "members"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, members, held = [], [], 0
    for batch in batches:
        for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist()):
            texts.append(text)
            members.append(key)
            held += len(text)
            if held >= BLOCK_CHARS:
                yield _block(texts, members)
                texts, members, held = [], [], 0
    if texts:
        yield _block(texts, members)


def add_to_text_index(rows: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str], part: int = 0) -> None:
    """Adds the texts of ``rows`` in ``columns``, under their keys, as part ``part`` of the index.

    A part is written over when it comes again. A row whose text has changed is added once more; its old
    entries only make it a candidate in vain.
    """
    texts = rows.select(_searched(columns).alias("text"), F.array(*[F.col(k).cast("string") for k in keys]).alias("key"))
    found = texts.mapInArrow(_blocks, LISTS).withColumn("part", F.lit(part))
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LISTS}, part int").parquet(path)


def _rarest(spark: SparkSession, path: str, wanted: str) -> list[str] | None:
    """The wanted text's rarest trigrams; None if one of them stands nowhere."""
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    counts = _lists(spark, path).where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n"))
    found = {r["gram"]: r["n"] for r in counts.collect()}  # one row a trigram asked for
    return sorted(grams, key=lambda g: (found.get(g, 0), g))[:RAREST] if len(found) == len(grams) else None


def candidates(spark: SparkSession, path: str, wanted: str, keys: Sequence[str]) -> DataFrame | None:
    """Keys, as text, of the rows that may contain the lower-case text; None if it is too short to tell."""
    if len(wanted) < 3:
        return None
    grams = _rarest(spark, path, wanted)
    named = [F.get("key", F.lit(i)).alias(k) for i, k in enumerate(keys)]
    lists = _lists(spark, path)
    asked = lists.where(F.col("gram").isin(grams or []))
    # A block's lists are as long as the block; those of one block are few.
    hit = asked.groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(grams or []))
    places = F.aggregate(F.slice("lists", 2, len(grams or [1])), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    hit = hit.select("block", places.alias("places")).where(F.size("places") > 0)
    members = lists.where(F.col("gram") == "").select("block", "members").join(hit, "block")
    return members.select(F.explode(F.transform("places", lambda i: F.get("members", i))).alias("key")).select(*named).distinct()


def search_text(rows: DataFrame, path: str, wanted: str, columns: Sequence[str], keys: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows one of whose ``columns`` contains ``wanted``, whatever the case; the index only says where to look.

    ``partition_by`` names keys that the table of ``rows`` is partitioned by: of it, only the partitions that hold a
    candidate are read. A blank ``wanted`` keeps all rows.
    """
    words = wanted.lower().strip()
    if not words:
        return rows
    found = candidates(rows.sparkSession, path, words, keys)
    if found is not None:
        kinds = dict(rows.dtypes)
        found = found.select(*[F.col(k).cast(kinds[k]) for k in keys])
        if partition_by:
            # One row per partition of the table at most.
            rows = rows.join(F.broadcast(found.select(*partition_by).distinct()), list(partition_by), "left_semi")
        rows = rows.join(found, list(keys), "left_semi")
    hits = [F.contains(F.lower(text_of(F.col(c).cast("string"))), F.lit(words)) for c in columns]
    return rows.where(functools.reduce(lambda a, b: a | b, hits))
