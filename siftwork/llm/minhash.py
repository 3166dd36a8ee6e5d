"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Signature: a shingle's hash is a place on a circle of 2^32; a first permutation scatters the places,
and coordinate k is the least value of a second permutation of the places turned by k steps. So two
permutations give all coordinates. Bands of ``ROWS`` coordinates are buckets; a pair of similarity
0.8 shares none of ``BANDS`` buckets with a probability below 1e-7.

Buckets may be huge (a third of all documents may be near copies of one text), so pairs within a bucket
are never listed. Documents with equal sets are one node. Every bucket first gets a centre, its
member with the most company over all buckets, and only the links of members to their centre are
verified; these nearly always connect what is connected. What is left are the members outside the
component that has most members in their bucket. They are a query set: each is compared, in blocks
and on full sets, with all members of the buckets of that component. So every two documents that
share a bucket are either in one component already or compared, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.shared import free_name, stored
from siftwork.llm.worker import mixed, shingle_hashes, slices, texts, word_hashes

BANDS, ROWS = 32, 4
LIKE, OF = 80, 100  # linked if OF * shared >= LIKE * all
BLOCK = 2_000  # nodes compared at a time, on either side
BYTES = 6  # of a shingle's hash in a stored set

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles, A-Z lowered; empty for a text without words."""
    return np.unique(shingle_hashes(word_hashes(text.encode().translate(LOWER).split()), width) >> np.uint64(64 - 8 * BYTES))


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash of a set that is not empty."""
    places = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    turns = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(places), 512):
            x = places[None, i : i + 512] - turns
            # The second permutation: odd factors and a shifted exclusive or are bijections.
            x *= np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA77)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE3D)
            np.minimum(least, x.min(axis=1), out=least)
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band; the band's number is part of it."""
    bands = least.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return out


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return OF * shared >= LIKE * (a + b - shared)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(x, width) for x in texts(part)]
                columns = [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([buckets(signature(s)).astype(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "digest", "buckets"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(x, width) for x in texts(part)]
                same = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, part.column("digest").to_pylist())]
                keep = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("node").filter(keep), pa.array([packed(s) for s, k in zip(sets, same) if k], pa.binary())], names=["node", "hashes"])

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are alike enough."""
    for batch in batches:
        for part in slices(batch, "hashes_a", 2 << 20):
            out = []
            for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "hashes_a", "hashes_b"))):
                x, y = unpacked(x), unpacked(y)
                if linked(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the queries and the members of each block; rows come sorted by block, queries first."""
    key, asked, members = None, [], []

    def links() -> pa.RecordBatch:
        found = []
        if asked and members:
            sizes = np.array([len(s) for _, _, s in members])
            values = np.concatenate([s for _, _, s in members])
            owner = np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            part = np.array([c for _, c, _ in members])
            nodes = np.array([n for n, _, _ in members])
            for node, component, own in asked:
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                counts = high - low
                at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                shared = np.bincount(owner[at], minlength=len(members))
                # One link to each other component is enough to join the two.
                good = np.flatnonzero(linked(shared, sizes, len(own)) & (part != component))
                _, first = np.unique(part[good], return_index=True)
                found += [(node, int(nodes[i])) for i in good[first]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for part in slices(batch, "hashes", 2 << 20):
            for row in part.to_pylist():
                if (row["grp"], row["ask"], row["chunk"]) != key:
                    yield links()
                    key, asked, members = (row["grp"], row["ask"], row["chunk"]), [], []
                (asked if row["asks"] else members).append((row["node"], row["comp"], unpacked(row["hashes"])))
    yield links()


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node of ``links`` (a, b): the smallest node that it is connected to.

    Labels go along links and then jump to their own labels, so their reach doubles with each round;
    each round is a table of its own in the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("before"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = stored(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "before"), "labels")
        if moved.where("comp <> before").isEmpty():
            return moved.select("node", "comp")
        labels = moved.select("node", "comp")


def _grouped(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, group, component_id`` of every row; the group is null without words or id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    signed = keyed.mapInArrow(_signed(width), "doc_id long, text_key long, n_shingles long, digest binary, buckets array<long>")
    # Numbers of rows are fixed once they are written, so a set is named by the least of its rows', whatever ids repeat.
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    some = signed.where("digest is not null and doc_id is not null")
    # One node per distinct set: copies are counted out before anything else is shuffled.
    nodes = stored(some.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")), "nodes")
    rows = nodes.select(F.explode("buckets").alias("bucket"), "node", "n")
    crowds = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(rows.join(crowds, "bucket"), "buckets")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    centred = shared.join(company, "node")
    centres = centred.groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("company", -F.col("node"))).alias("centre"))
    fits = OF * F.least("n", "centre.n") >= LIKE * F.greatest("n", "centre.n")
    pairs = shared.join(centres, "bucket").where((F.col("node") != F.col("centre.node")) & fits).select(F.col("node").alias("a"), F.col("centre.node").alias("b")).distinct()
    wanted = company.select("node").join(nodes.select("node", "id", "digest"), "node")
    source = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("node", "digest", "text")
    sets = stored(source.mapInArrow(_sets(width), "node long, hashes binary").dropDuplicates(["node"]), "sets")
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    links = stored(with_both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_confirmed, "a long, b long"), "links")
    first = components(links)

    # Members outside the largest component of their bucket; a pair alone in its bucket is decided.
    placed = shared.where("size > 2").join(first, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    heads = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("grp"), F.count("*").alias("comps")).where("comps > 1")
    open_ = placed.join(heads.select("bucket", "grp"), "bucket")
    members = stored(open_.groupBy("grp", "node").agg(F.first("comp").alias("comp")), "open")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum((F.col("comp") != F.col("grp")).cast("long")).alias("m"))
    sized = members.join(sizes, "grp").withColumns({"chunks": F.ceil(F.col("n") / BLOCK), "asks": F.ceil(F.col("m") / BLOCK)})
    spot = F.xxhash64("node")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    one_of = lambda n: F.pmod(spot, F.col(n)).cast("int")
    queries = sized.where("comp <> grp").select("grp", one_of("asks").alias("ask"), F.explode(all_of("chunks")).alias("chunk"), F.lit(True).alias("asks"), "node", "comp")
    asked = sized.select("grp", F.explode(all_of("asks")).alias("ask"), one_of("chunks").alias("chunk"), F.lit(False).alias("asks"), "node", "comp")
    blocks = queries.union(asked).join(sets, "node").repartition("grp", "ask", "chunk").sortWithinPartitions("grp", "ask", "chunk", F.desc("asks"))
    more = stored(blocks.mapInArrow(_compared, "a long, b long"), "links")
    # Components are nodes now; a link between two of them joins them.
    named = lambda c: F.coalesce(F.col(f"{c}_comp"), F.col(c))
    joined = more.join(first.select(F.col("node").alias("a"), F.col("comp").alias("a_comp")), "a", "left").join(first.select(F.col("node").alias("b"), F.col("comp").alias("b_comp")), "b", "left")
    second = components(joined.select(named("a").alias("a"), named("b").alias("b")).where("a <> b"))
    own = nodes.select("digest", "id", "node").join(first, "node", "left").select("digest", "id", F.coalesce("comp", "node").alias("middle"))
    final = stored(own.join(second.select(F.col("node").alias("middle"), "comp"), "middle", "left").select("digest", "id", F.coalesce("comp", "middle").alias("group")), "groups")
    # Only groups of several sets need their smallest id looked up; of the others it is their own.
    least = final.groupBy("group").agg(F.min("id").alias("least"), F.count("*").alias("sets")).where("sets > 1").select("group", "least")
    named_groups = final.join(least, "group", "left").select("digest", "group", F.coalesce("least", "id").alias("found"))
    out = signed.select("doc_id", "text_key", "n_shingles", "digest").join(named_groups, "digest", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"), F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))


def _own() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: its component's smallest id, and whether it is its own.

    ``width`` is the words of a shingle; a text with fewer words is one shingle. A text without words
    (null, empty, blank) has an empty set and is linked with nothing. Rows with a null ``doc_id`` are
    linked with nothing: their component is null and they are not kept. A repeated id is one node per
    set of shingles: rows of one id with different texts are linked each by its own text, and are in
    one component only if their texts are linked. An empty table gives an empty one; other columns are not read.
    """
    return _grouped(docs, width).select("doc_id", "n_shingles", "component_id", _own().alias("kept"))


def first_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that their component of near duplicates keeps; all columns stay.

    Of a component's rows that have its smallest id one text stays, and of equal rows one. So different texts
    of one id stay each, unless they are near duplicates of one another. Rows without an id stay.
    """
    name, key, free = (free_name(docs, x) for x in ("_kept", "_text_key", "_of_text"))
    kept = _grouped(docs, width).where(_own()).groupBy("doc_id", F.coalesce("group", "text_key").alias("group")).agg(F.min("text_key").alias("text_key"))
    kept = kept.select(F.col("doc_id").alias(name), F.col("text_key").alias(free)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    one = keyed.join(kept, (F.col("doc_id").cast("long") == F.col(name)) & (F.col(key) == F.col(free)), "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
