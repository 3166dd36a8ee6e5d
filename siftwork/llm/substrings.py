"""Words of passages that stand earlier in the corpus removed, by FM-indexes over shards.

A window is ``WINDOW`` words of one document. Its anchor is the least hash among its runs of ``GRAM``
words, so equal windows have equal anchors wherever they stand. Neighbouring windows with one anchor
form a segment, and a shard is the set of segments whose anchors fall into it: every window lies in
one shard, with all its equals, and a document is streamed only through the shards of its own anchors.

Segments whose anchor occurs once are done. Equal segments are stored once, with their first place;
each shard indexes its stored segments in the order of their places, searches all their windows
backward, and reports the windows that occur at an earlier place. Of a segment's later copies every
window occurs earlier. An anchor with more than ``CROWD`` different segments would make a shard of its own
that grows with the corpus, so it is not indexed: the windows of all its segments are combined by their
digests to their first places before they move, and every other place of a window is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.fmindex import FMIndex
from siftwork.llm.shared import free_name, stored
from siftwork.llm.worker import memo, mixed, shingle_hashes, slices, texts

WINDOW, GRAM = 20, 5
CROWD = 20_000
SHARD = 1 << 20  # symbols of an index, about
BYTES = 5  # of a word's hash in a stored segment
HASHED = 1 << 20  # bytes of text whose words are hashed at a time, one text at least
LONG = 256  # bytes; longer words have a hash of their own
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

ODD = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64, and their inverses."""
    with np.errstate(over="ignore"):
        up = np.full(n, ODD, np.uint64)
        down = np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def digests(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run of words from ``start`` to ``stop``, wherever it stands."""
    kept = memo("powers", dict)
    if len(kept.get("powers", [()])[0]) <= len(words):
        kept["powers"] = powers(len(words) + 1)
    up, down = kept["powers"]
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def hashed(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and where each text's begin, with the end."""
    raw = b"\n".join([b"", *found, b""])
    letters = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(BLANK[letters])) + 1
    start, stop = edges[::2], edges[1::2]
    out = digests(mixed(np.arange(1, 257, dtype=np.uint64))[letters], start, stop)
    for i in np.flatnonzero(stop - start > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : stop[i]])
    begins = np.cumsum([1, *(len(x) + 1 for x in found)])
    return out, np.searchsorted(start, begins)


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``hashed`` of the texts of a batch, a bounded number of bytes at a time."""
    words, bounds, held, size, total = [], [np.zeros(1, np.int64)], [], 0, 0
    found = [x.encode() for x in texts(part)]
    for i, text in enumerate(found, 1):
        held.append(text)
        size += len(text) + 1
        if size >= HASHED or i == len(found):
            some, ends = hashed(held)
            words.append(some)
            bounds.append(ends[1:] + total)
            total += len(some)
            held, size = [], 0
    return np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(bounds)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value in each run of ``width``, the first of equal ones."""
    at, span = np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        later = values[step:] < values[:-step]
        at = np.where(later, at[step:], at[:-step])
        values = np.where(later, values[step:], values[:-step])
        span += step
    return at


def segments(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text, first window (by its place among all words) and number of windows of each segment of the texts."""
    counts = np.maximum(np.diff(bounds) - WINDOW + 1, 0)
    if not counts.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    grams = shingle_hashes(words, GRAM)
    owner = np.repeat(np.arange(len(counts)), counts)
    windows = np.arange(len(owner)) + np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts)
    at = least(grams, WINDOW - GRAM + 1)[windows]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return grams[at[first]], owner[first], windows[first], np.diff(np.append(first, len(at)))


SEGMENT = "anchor long, digest long, doc_id long, start int, windows int, state int"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of all texts. State 2: the same anchor has come earlier in this slice of the table;
    1: it has not, but it comes again; 0: it comes once. Only states 0 and 1 need to meet by anchor."""
    for batch in batches:
        for part in slices(batch, "text", 8 << 20):
            words, bounds = words_of(part)
            anchor, owner, first, count = segments(words, bounds)
            if len(anchor):
                digest = digests(words, first, first + count + WINDOW - 1)
                doc, start = part.column("doc_id").to_numpy(zero_copy_only=False)[owner], first - bounds[owner]
                _, place, where, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                state = np.full(len(anchor), 2)
                state[place] = (times > 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(state, pa.int32())],
                    names=["anchor", "digest", "doc_id", "start", "windows", "state"],
                )


STORED = "anchor long, digest long, doc_id long, start int, windows int, words binary"


def _stored_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the first copies of segments, as hashes."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, bounds = words_of(part)
            wanted = part.column("firsts")
            own = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
            anchor, digest, at, windows = (x.to_numpy() for x in wanted.flatten().flatten())
            start = bounds[own] + at
            stop = start + windows + WINDOW - 1
            inside = stop <= bounds[own + 1]
            real = digests(words, np.where(inside, start, 0), np.where(inside, stop, 0)).view(np.int64)
            good = inside & (real == digest)  # else another row has the same id and other words
            start, sizes = start[good], (stop - start)[good]
            if not len(start):
                continue
            raw = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]
            ends = np.cumsum(sizes)
            data = raw[np.arange(ends[-1]) + np.repeat(start - ends + sizes, sizes)]
            offsets = np.concatenate(([0], ends * BYTES)).astype(np.int32)
            columns = [anchor[good], digest[good], part.column("doc_id").to_numpy(zero_copy_only=False)[own][good], at[good], windows[good]]
            kept = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), kept], names=[c.split()[0] for c in STORED.split(", ")])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stored segment, which of its windows occur earlier; rows come sorted by shard and place."""
    shard, held = None, []

    def report() -> pa.RecordBatch:
        anchors, digest, windows, raw = zip(*held)
        sizes = np.array([len(x) // BYTES for x in raw])
        flat = np.zeros((int(sizes.sum()), 8), np.uint8)
        flat[:, :BYTES] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BYTES)
        symbols = np.unique(flat.view("<u8").ravel(), return_inverse=True)[1] + 1
        # Each segment is followed by a separator.
        begins = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(len(symbols) + len(sizes), np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
        counts = np.array(windows)
        owner = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = begins[owner] + offset
        earlier = FMIndex(text).repeats(text, places, WINDOW) < places
        owner, offset = owner[earlier], offset[earlier]
        take = lambda x: pa.array(np.array(x)[owner], pa.int64())
        return pa.RecordBatch.from_arrays([take(anchors), take(digest), pa.array(offset, pa.int32())], names=["anchor", "digest", "window"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "anchor", "digest", "windows", "words")]
        for key, *row in zip(*columns):
            if key != shard:
                if held:
                    yield report()
                shard, held = key, []
            # Rows of one id that are alike give a segment twice, one after the other.
            if not held or held[-1] != row:
                held.append(row)
    if held:
        yield report()


def _crowded_repeats(docs: DataFrame, anchors: list[int], hot: int) -> DataFrame:
    """``doc_id, start, windows`` of the windows with one of these anchors that occur at an earlier place."""
    known = docs.sparkSession.sparkContext.broadcast(np.array(sorted(anchors), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                words, bounds = words_of(part)
                anchor, owner, first, count = segments(words, bounds)
                crowded = np.isin(anchor.view(np.int64), known.value)
                owner, first, count = owner[crowded], first[crowded], count[crowded]
                if len(first):
                    owner = np.repeat(owner, count)
                    at = np.arange(len(owner)) + np.repeat(first - np.cumsum(count) + count, count)
                    key, doc = digests(words, at, at + WINDOW), part.column("doc_id").to_numpy(zero_copy_only=False)[owner]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc, pa.int64()), pa.array(at - bounds[owner], pa.int32())], names=["key", "doc_id", "start"])

    windows = stored(docs.mapInArrow(run, "key long, doc_id long, start int"), "windows")
    firsts = stored(windows.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "window_firsts")
    # At most one of ``hot`` windows is hot, so these first places may go to all tasks; the others are small groups.
    often = F.broadcast(firsts.where(F.col("n") > hot).select("key", "first"))
    rare = firsts.where(F.col("n") <= hot).select("key", "first")
    met = windows.join(often, "key").unionByName(windows.join(often.select("key"), "key", "left_anti").join(rare, "key"))
    return met.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).select("doc_id", "start", F.lit(1).alias("windows"))


def repeated_windows(docs: DataFrame, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """``doc_id, start, windows``: runs of windows whose words stand earlier, by the id of the document they are in."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    found = docs.mapInArrow(_anchored, SEGMENT)
    dealt = F.when(F.col("state") == 2, F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy(dealt)))
    places = stored(counted.where("n > 1 or state > 0").select("anchor", "digest", "doc_id", "start", "windows"), "places")
    known = stored(places.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.first("windows").alias("windows")), "firsts")
    # At most one anchor for each ``crowd`` segments.
    crowded = [r["anchor"] for r in known.groupBy("anchor").count().where(F.col("count") > crowd).collect()]
    if crowded:
        apart = F.broadcast(docs.sparkSession.createDataFrame([(a,) for a in crowded], "anchor long"))
        known, places = (x.join(apart, "anchor", "left_anti") for x in (known, places))
    total = known.agg(F.coalesce(F.sum(F.col("windows") + WINDOW), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    wanted = known.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "digest", F.col("first.start").alias("start"), "windows")).alias("firsts"))
    texts_of = docs.join(wanted, "doc_id").select("doc_id", "text", "firsts")
    indexed = texts_of.mapInArrow(_stored_words, STORED).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select("shard", "anchor", "digest", "windows", "words", "doc_id", "start")
    reports = indexed.repartition("shard").sortWithinPartitions("shard", "doc_id", "start").drop("doc_id", "start").mapInArrow(_searched, "anchor long, digest long, window int")
    earlier = reports.groupBy("anchor", "digest").agg(F.collect_list("window").alias("earlier"))
    copies = places.join(known.select("anchor", "digest", "first").join(earlier, ["anchor", "digest"], "left"), ["anchor", "digest"])
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    single = F.transform(F.coalesce("earlier", F.array().cast("array<int>")), lambda w: F.struct((F.col("start") + w).alias("start"), F.lit(1).alias("windows")))
    runs = F.when(own, single).otherwise(F.array(F.struct("start", "windows")))
    found = copies.select("doc_id", F.explode(runs).alias("run")).select("doc_id", "run.start", "run.windows")
    return found.unionByName(_crowded_repeats(docs, crowded, crowd)) if crowded else found


def kept_words(words: list[bytes], runs: list[dict] | None) -> list[bytes]:
    """The words that no window of the runs covers."""
    if not runs or len(words) < WINDOW:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.array([r["start"] for r in runs])
    ends = starts + np.array([r["windows"] for r in runs]) + WINDOW - 1
    inside = ends <= len(words)
    np.add.at(edges, starts[inside], 1)
    np.add.at(edges, ends[inside], -1)
    return [w for w, gone in zip(words, np.cumsum(edges[:-1]).tolist()) if not gone]


def without_repeats(docs: DataFrame, column: str = "kept") -> DataFrame:
    """``docs`` with ``column``: a struct of ``n_words``, ``n_removed`` and ``text``, the kept words joined by a blank.

    A word is removed if a window that covers it has words that also start earlier: in a document of
    smaller ``doc_id``, or earlier in the same one; windows are judged on the input. A null text has
    no words, and a text of fewer than ``WINDOW`` words keeps them all, as do rows whose ``doc_id`` is
    null, which are not compared. Rows that share an id are one document, so a window at the same
    place of two of them is not a repeat. Rows and all other columns stay as they are.
    """
    of, cut = free_name(docs, "_of"), free_name(docs, "_runs")
    runs = repeated_windows(docs).groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("start", "windows")).alias(cut))
    joined = docs.drop(column).join(runs, F.col("doc_id").cast("long") == F.col(of), "left").drop(of)
    names = [c for c in joined.columns if c != cut]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != cut) + f", `{column}` struct<n_words: bigint, n_removed: bigint, text: string>"
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, own in zip(texts(part), part.column(cut).to_pylist()):
                    words = text.encode().split()
                    kept = kept_words(words, own)
                    out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "text": b" ".join(kept).decode()})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, kind)], names=[*names, column])

    return joined.mapInArrow(run, schema)


def shortened(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``n_chars`` to match; texts without any stay as they are."""
    mark = free_name(docs, "_kept")
    found = without_repeats(docs, mark)
    cut = F.col(f"{mark}.n_removed") > 0
    out = found.withColumn("text", F.when(cut, F.col(f"{mark}.text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def removal_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row; see ``without_repeats``."""
    found = without_repeats(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return found.select("doc_id", "kept.n_words", "kept.n_removed", F.sha2(F.col("kept.text"), 256).alias("kept_sha256"))

