"""Helpers that run inside Python workers: state kept between tasks, Arrow batches, hashes."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext


def memo(key: Any, make: Callable[[], Any]) -> Any:
    """A value built once per worker process and stage.

    The package is pickled into the tasks, so its module globals live for one task only; a
    reused worker keeps this table on ``sys`` instead.
    """
    kept = _kept()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _kept() -> dict[Any, Any]:
    """The values of the running stage.

    A worker serves one stage after another, and what earlier ones learned (models, caches) would
    add up; so a new stage lets it go, and the freed memory goes back to the machine.
    """
    task = TaskContext.get()
    stage = task.stageId() if task else None
    held = sys.__dict__.setdefault("_siftwork_llm_memo", {})
    if held.get("stage", stage) != stage:
        held["values"] = None
        pa.default_memory_pool().release_unused()
    if held.get("values") is None:
        held["values"] = {}
    held["stage"] = stage
    return held["values"]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch whose ``column`` holds about ``most_bytes`` each, one row at least."""
    _kept()  # also stages that keep nothing let go of what is left of others
    if not batch.num_rows:
        return
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], dtype=_offset(batch, column), count=batch.num_rows + 1 + batch.column(column).offset)[batch.column(column).offset :])
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _offset(batch: pa.RecordBatch, column: str) -> str:
    kind = batch.schema.field(column).type
    return "<i8" if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else "<i4"


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


class Hashes(dict):
    """64-bit hashes of byte strings, computed once each; emptied when it holds ``limit`` of them."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, key: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = xxhash.xxh3_64_intdigest(key)
        return value

    def of(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), dtype=np.uint64, count=len(keys))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return memo("word_hashes", Hashes).of(words)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (murmur's finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` words; with fewer words the whole run is the only one."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    out = np.full(count, np.uint64(width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += words[i : i + count]
        return mixed(out)
