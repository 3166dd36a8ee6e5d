"""Bottom-k sketches of documents: the ``K`` smallest hashes of a text's distinct word shingles.

The sketch of a union is the ``K`` smallest of both sketches, so sketches of parts merge into the
sketch of the whole. Among the ``K`` smallest hashes of a union, those that both sides hold estimate
the resemblance; the K-th smallest hash estimates how many shingles there are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.worker import shingle_hashes, slices, word_hashes

K = 128
WIDTH = 5  # words of a shingle
BYTES = 5  # of a hash; 40 bits tell the shingles of two documents apart

LOWEST = -(1 << 63)


def sketch(text: str, k: int = K) -> np.ndarray:
    """The sketch of a text: ascending distinct hashes, ``k`` at most; empty for a text without words."""
    words = text.encode().split()
    hashes = shingle_hashes(word_hashes(words), WIDTH) >> np.uint64(64 - 8 * BYTES)
    if len(hashes) > 4 * k:
        # Repeats take places among the smallest, so look further until k different ones are found.
        take = 2 * k
        while take < len(hashes):
            least = np.unique(np.partition(hashes, take)[:take])
            if len(least) > k:  # one may be missing repeats beyond, but no smaller hash is
                return least[:k]
            take *= 4
    return np.unique(hashes)[:k]


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of a text from the sketches of its parts' shingles."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def text_of(part: np.ndarray) -> str:
    """A sketch as text: its hashes, big-endian, in base 64."""
    raw = part.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def sketch_of(text: str) -> np.ndarray:
    """The sketch that ``text_of`` has written."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - BYTES :] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """How many distinct shingles a text has; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << 8 * BYTES) / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared shingles over all shingles of two texts; 1 for two texts without words."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of the first text's shingles that the second has."""
    if not len(a):
        return 1.0
    both = distinct_shingles(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * both / distinct_shingles(a, k))


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt into blocks of falling ``doc_id``, each block with the row that follows it.

    Quantiles of ``doc_id``, one per partition, are the largest ids of the blocks; they are values
    of the table, so the row that starts a block is known by its id alone and is sent to the block
    before it as well. A block is then sorted and read as a stream.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts + 1)]
    found = docs.agg(F.percentile_approx("key", shares, 20 * parts).alias("q"), F.max("key").alias("top")).first()
    tops = np.unique(np.array([*(found["q"] or []), *([] if found["top"] is None else [found["top"]])], dtype=np.int64))
    last = max(0, len(tops) - 1)

    @F.pandas_udf("array<int>")
    def blocks(key: pd.Series) -> pd.Series:
        at = np.searchsorted(tops, key.to_numpy(), side="left")
        heads = tops[np.minimum(at, last)] == key.to_numpy()
        # Blocks count from the top: the block above the head's own has the head as its follower.
        return pd.Series([[last - i, (last - i - 1) % (last + 1)] if head else [last - i] for i, head in zip(at.tolist(), heads.tolist())])

    rows = docs.select("*", F.posexplode(blocks("key")).alias("follower", "block"))
    # A block's number is its task's: by hashes of the numbers several blocks would meet in one task.
    return rows.repartitionById(parts, "block").sortWithinPartitions("block", "follower", F.desc("key"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, of its edited text, and how alike they and the next text's are.

    ``next`` is the row with the next lower ``doc_id`` (after the lowest: the highest); rows of equal
    id follow each other by text, null ids come last. A null text is empty; a text of fewer than five
    words is one shingle; a text without words has the empty fingerprint, which is like another empty
    one only. Repeated rows stay; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # of the block's row that waits for its follower
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for row in part.to_pylist():
                    own = row["text"], sketch(row["text"])
                    if before is not None and before[0] == row["block"]:
                        _, doc_id, text, mine = before
                        other = edited(text, own[0])
                        changed = sketch(other)
                        out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), text_of(mine), text_of(changed), resemblance(mine, changed), resemblance(mine, own[1])))
                    before = None if row["follower"] else (row["block"], row["doc_id"], *own)
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs).mapInArrow(run, schema)
