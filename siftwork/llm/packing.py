"""Documents packed in order into sequences of at most ``window`` tokens.

The documents of one range of ``doc_id`` form a stream of ids. Cuts may fall at document ends, at
sentence ends, and, where neither is near, every ``STRIDE`` ids. The cheapest set of cuts is found
by dynamic programming over these places: a sequence from i to j costs its padding plus what a cut
at j costs. Padding is ``window - (j - i)``, so the best i is the least ``cost[i] + i`` in a window
that slides with j, which a monotone queue gives in constant time. A sequence whose length is a power
of two needs no padding; this is used near the stream's end, where the rest would be padded.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftwork.llm.token_files import KEPT, in_order
from siftwork.llm.tokens import Encoder, encoder
from siftwork.llm.worker import memo, slices, texts

SENTENCE_CUT = 4  # a cut inside a document, at a sentence's end, counts as so many padded places
OTHER_CUT = 20  # a cut inside a sentence
STRIDE = 32  # places for cuts inside a sentence
BUFFER = 1 << 18  # ids for which cuts are chosen at a time; the last two sequences are left to the next

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def sentence_ends(own: Encoder) -> np.ndarray:
    """For each id of a byte-level vocabulary, whether a sentence or line may end with it."""
    vocabulary = own.library.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    line = own.letters[10]
    for token, i in vocabulary.items():
        ends[i] = token[-1:] in {".", "!", "?"} or line in token
    return ends


def places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut (0 and its end included), and what a cut there costs."""
    ends_here = np.flatnonzero(ends[ids]) + 1
    inner = np.union1d(np.union1d(ends_here, doc_ends), [0, len(ids)])
    gaps = np.diff(inner)
    wide = np.flatnonzero(gaps > STRIDE)
    more = [np.arange(inner[i] + STRIDE, inner[i + 1], STRIDE) for i in wide]
    where = np.union1d(inner, np.concatenate(more)) if more else inner
    cost = np.full(len(where), OTHER_CUT)
    cost[np.searchsorted(where, ends_here)] = SENTENCE_CUT
    cost[np.searchsorted(where, doc_ends)] = 0
    cost[0] = cost[-1] = 0
    return where.astype(np.int64), cost.astype(np.int64)


def best_cuts(where: np.ndarray, cost: np.ndarray, window: int, last: bool) -> list[int]:
    """The places that end a sequence, at the least total cost. No gap is wider than ``window``."""
    at, price = where.tolist(), cost.tolist()
    n = len(at)
    total, came = [0] * n, [0] * n
    key = [0] * n
    queue = deque([0])
    near_end = at[-1] - 4 * window if last else at[-1] + 1
    index = {}
    for j in range(1, n):
        here = at[j]
        low = here - window
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - here
        if here > near_end:
            index[here] = j
            size = window >> 1
            while size:
                k = index.get(here - size)
                # One place more for each such sequence: of equal costs the longer sequence is better.
                if k is not None and total[k] + 1 < best:
                    best, i = total[k] + 1, k
                size >>= 1
        total[j] = best = best + price[j]
        came[j] = i
        key[j] = own = best + here
        while queue and key[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence, and the ids.

    A document's ids are those of its text by the tokenizer file ``path``, then ``end_id``. A null
    text counts as empty; a null ``doc_id`` is kept; repeated rows are packed each; an empty table
    gives no row; other columns are not read. ``sequence_id`` is the number of the range times
    2^32 plus the number within the range, so it ascends with ``doc_id``. ``ids`` are unsigned
    32-bit little-endian integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path, KEPT), TaskContext.get().partitionId()
        ends = memo(("sentence_ends", path), lambda: sentence_ends(own))
        sequence = part << 32
        stream: list[np.ndarray] = []
        # Of each document that has ids in the stream: its id, number of ids, ids already packed.
        names, sizes, done, held = [], [], [], 0

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal sequence, stream, names, sizes, done, held
            ids = np.concatenate(stream)
            left = np.array(sizes) - np.array(done)
            doc_ends = np.cumsum(left)
            cuts = best_cuts(*places(ids, doc_ends, ends), window, last)
            if not last:
                cuts = cuts[:-2]
            stop = cuts[-1]
            edges = np.array(cuts)
            bounds = np.union1d(np.union1d(doc_ends[doc_ends < stop], edges), [0])
            low, high = bounds[:-1], bounds[1:]
            doc = np.searchsorted(doc_ends, low, side="right")
            which = np.searchsorted(edges, low, side="right")
            starts = np.concatenate(([0], edges[:-1]))
            first = doc_ends - left
            raw = [ids[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())]
            columns = [
                pa.array([names[i] for i in doc], pa.int64()),
                pa.array(np.array(done)[doc] + low - first[doc], pa.int64()),
                pa.array(high - low, pa.int64()),
                pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                pa.array(np.array(sizes)[doc], pa.int64()),
                pa.array(sequence + which, pa.int64()),
                pa.array(low - starts[which], pa.int64()),
                pa.array(raw, pa.binary()),
            ]
            sequence += len(cuts)
            kept = int(np.searchsorted(doc_ends, stop, side="right"))
            done = [int(max(0, stop - f)) + d for f, d in zip(first[kept:].tolist(), done[kept:])]
            names, sizes = names[kept:], sizes[kept:]
            stream, held = [ids[stop:]], len(ids) - stop
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                found, at = own.encode(texts(piece))
                for i, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                    stream += [found[at[i] : at[i + 1]], np.array([end_id], "<u4")]
                    size = int(at[i + 1] - at[i]) + 1
                    names.append(doc_id)
                    sizes.append(size)
                    done.append(0)
                    held += size
                    if held >= BUFFER:
                        yield packed(last=False)
        if held:
            yield packed(last=True)

    return in_order(docs).mapInArrow(run, PIECES)
