"""Which conversations begin alike: every distinct sequence of first turns, from sharded z-fast tries.

A turn becomes a symbol (a digest of role and text, and the number of its words), a conversation the path of
its symbols, and equal paths one row, so that no very common conversation is sent twice. Paths are dealt out by
ranges: a range holds some ``TURNS`` turns and the beginnings it shares with its neighbours are those
of its first and its last path. Each range becomes a z-fast trie: compacted nodes lie in a hash table under
the digest of their prefix at the two-fattest depth of their edge, a path's exit node is found by fat binary search
in steps logarithmic in its turns, and paths are inserted in batches. Its edges are then expanded to one row per
beginning. Beginnings that ranges share are added up afterwards; all numbers of a node are sums or
minima over ranges, since a node is counted only by the range in which it first appears.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.shared import stored

TURNS = 50_000  # turns of a range, which one task holds (a longer conversation is a range of its own)
BATCH = 1024  # paths that are located before they are inserted
MEMBERS = 12  # bits of ids whose list is put together by one task, 4096 ids
SYMBOL = 20  # bytes: 16 of a digest, 4 for the number of words
HEAD = 3  # turns that may come from another conversation, at most

NOTHING = sha256(b"").hexdigest()
NODE = "part int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# The trie of one range


def fattest(low: int, high: int) -> int:
    """The number above ``low``, up to ``high``, that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def chain_of(path: bytes) -> list[bytes]:
    """Digests of all prefixes of a path, each made from the one before."""
    chain = [b""]
    for at in range(0, len(path), SYMBOL):
        chain.append(blake2b(chain[-1] + path[at : at + SYMBOL], digest_size=16).digest())
    return chain


class Node:
    """A compacted node: depths ``start`` to ``end`` of the path it was made for, and what ends there."""

    __slots__ = ("above", "below", "start", "end", "path", "chain", "n", "least", "ends", "leaves", "saved")

    def __init__(self, above: Node | None, start: int, end: int, path: bytes, chain: list[bytes]):
        self.above, self.start, self.end, self.path, self.chain = above, start, end, path, chain
        self.below: dict[bytes, Node] = {}
        self.n, self.least, self.ends = 0, None, None
        self.leaves = self.saved = 0

    def handle(self) -> bytes:
        return self.chain[fattest(self.start - 1, self.end)]

    def words(self, depth: int) -> int:
        return int.from_bytes(self.path[depth * SYMBOL - 4 : depth * SYMBOL], "big")

    def begins(self, chain: list[bytes]) -> bool:
        return self.end < len(chain) and chain[self.end] == self.chain[self.end]


class Trie:
    """A z-fast trie of distinct paths."""

    def __init__(self):
        self.root = Node(None, 0, 0, b"", [b""])
        self.handles: dict[bytes, Node] = {}
        self.probes = 0

    def locate(self, chain: list[bytes], node: Node | None = None) -> tuple[Node, Node]:
        """The deepest node whose whole extent begins the path, and the exit node: it, or its child that the path leaves inside.

        ``node`` is one that begins the path, by default the root. Handles are looked up by fat binary search over depths.
        """
        node = node or self.root
        low, high = node.end, len(chain) - 1
        while low < high:
            depth = fattest(low, high)
            self.probes += 1
            found = self.handles.get(chain[depth])
            if found is None:
                high = depth - 1
            elif found.begins(chain):
                node, low = found, found.end
            else:
                return found.above, found
        return node, node.below.get(chain[low + 1], node) if low + 1 < len(chain) else node

    def insert(self, rows: list[tuple[bytes, int, int, str]]) -> None:
        """A batch of distinct paths with the number of their conversations, the smallest id and the digest of all ids.

        All are located in the trie as it is; each insertion then searches on from there.
        """
        chains = [chain_of(path) for path, *_ in rows]
        known = [self.locate(chain)[0] for chain in chains]
        for (path, n, least, ends), chain, begin in zip(rows, chains, known):
            node, leaving = self.locate(chain, begin)
            depth = len(chain) - 1
            if leaving is not node:
                node = self._split(leaving, self._shared(leaving, chain))
            if node.end < depth:
                leaf = Node(node, node.end + 1, depth, path, chain)
                node.below[chain[leaf.start]] = self.handles[leaf.handle()] = node = leaf
            node.n, node.least, node.ends = n, least, ends

    @staticmethod
    def _shared(node: Node, chain: list[bytes]) -> int:
        """The depth inside a node's edge up to which it begins the path, by binary search over digests."""
        low, high = node.start - 1, min(node.end, len(chain) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if node.chain[middle] == chain[middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def _split(self, node: Node, depth: int) -> Node:
        del self.handles[node.handle()]
        upper = Node(node.above, node.start, depth, node.path, node.chain)
        node.above.below[node.chain[node.start]] = upper
        node.above, node.start = upper, depth + 1
        upper.below[node.chain[node.start]] = node
        self.handles[upper.handle()], self.handles[node.handle()] = upper, node
        return upper

    def expanded(self, first: list[bytes], last: list[bytes], before: int, after: int) -> Iterator[tuple]:
        """A row per beginning. Up to depth ``before`` those of the ``first`` path also belong to earlier ranges and were
        counted there, up to ``after`` those of the ``last`` one belong to later ones too (-1: there are none)."""

        def old(node: Node, depth: int) -> bool:
            return depth <= before and node.chain[depth] == first[depth]

        def later(node: Node, depth: int) -> bool:
            return depth <= after and node.chain[depth] == last[depth]

        def shared(node: Node, depth: int) -> bool:
            return old(node, depth) or later(node, depth)

        nodes, at = [self.root], 0
        while at < len(nodes):
            nodes += nodes[at].below.values()
            at += 1
        ended = {id(x): x.n for x in nodes}
        for node in reversed(nodes):
            # All that is below has been added up by now.
            if not node.below:
                node.leaves = 0 if later(node, node.end) else 1
            for depth in range(node.end, max(node.start, 1) - 1, -1):
                node.saved += (node.n - (not old(node, depth))) * node.words(depth)
            if node.above:
                up = node.above
                up.n += node.n
                up.leaves += node.leaves
                up.saved += node.saved
                up.least = node.least if up.least is None else min(up.least, node.least)
        for node in nodes:
            saved = node.saved
            for depth in range(node.start, node.end + 1):
                up = node.above if depth == node.start else node
                if depth < node.end:
                    children = int(not old(node, depth + 1))
                else:
                    children = sum(not old(x, x.start) for x in node.below.values())
                open_above = up is not None and shared(up, depth - 1)
                yield (
                    node.chain[depth] if shared(node, depth) else None, up.chain[depth - 1] if open_above else None, node.least, depth,
                    None if up is None or open_above else up.least, node.n, children, node.leaves, saved, node.ends if depth == node.end and ended[id(node)] else None,
                )
                saved -= (node.n - (not old(node, depth))) * node.words(depth) if depth else 0


# Paths of conversations


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path`` of every conversation as it is: its symbols in the order of turns, a null turn first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    symbol = F.concat(digest, F.lpad(F.hex(words.cast("long")), 8, "0"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), symbol.alias("symbol")).alias("row")
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return ordered.select("conv_id", F.unhex(F.array_join(F.transform("rows", lambda r: r["symbol"]), "")).alias("path"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path`` with the first h turns of conversation c - c % 20 in place of its own, h = crc32 of the id % 4."""
    own = paths(conversations)
    heads = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, HEAD * SYMBOL).alias("head"))
    size = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1) * SYMBOL).cast("int")
    nothing = F.unhex(F.lit(""))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left")
    head, rest = F.substring(F.coalesce("head", nothing), F.lit(1), size), F.substring(F.col("path"), size + 1, F.length("path"))
    return joined.select("conv_id", F.concat(head, rest).alias("path"))


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path from its lists of ids, which come in order: their number, the smallest, the digest of all."""
    own = path = digest = None
    total = least = 0
    for batch in batches:
        out = []
        for key, ids, n, smallest, its_path in zip(*(batch.column(c).to_pylist() for c in ("seq", "ids", "n", "least", "path"))):
            if key != own:
                if own is not None:
                    out.append((path, total, least, digest.hexdigest()))
                own, path, total, least, digest = key, its_path, 0, smallest, sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            total += n
        yield _columns(out, ["path", "n", "least", "ends"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])
    if own is not None:
        yield _columns([(path, total, least, digest.hexdigest())], ["path", "n", "least", "ends"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _distinct(conversations: DataFrame) -> DataFrame:
    """``path, n, least, ends`` per distinct path. Ids are listed by blocks of 4096, then hashed one list after another."""
    listed = conversations.withColumn("seq", F.substring(F.sha2("path", 256), 1, 32)).groupBy("seq", F.shiftright("conv_id", MEMBERS).alias("block"))
    lists = listed.agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("path").alias("path"))
    lists = lists.select("seq", "block", "path", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"))
    return lists.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(_endings, "path binary, n long, least long, ends string")


def _common(a: bytes | None, b: bytes | None) -> int:
    """Symbols that two paths share at their start, -1 if one of them isn't there."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // SYMBOL
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * SYMBOL] == b[: middle * SYMBOL]:
            low = middle
        else:
            high = middle - 1
    return low


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield _columns([(r["part"], _common(r["earlier"], r["first"]), _common(r["last"], r["next"])) for r in rows], ["part", "before", "after"], [pa.int32()] * 3)


def _ranges(distinct: DataFrame, turns: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The distinct paths with the number of their range, and per range the turns shared with its neighbours."""
    distinct = stored(distinct, "paths")
    total = distinct.agg(F.sum(F.length("path"))).first()[0] or 0
    parts = max(1, -(-total // (SYMBOL * turns)))
    ranged = stored(distinct.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("part")  # one row a range
    ends = ends.withColumn("earlier", F.lag("last").over(order)).withColumn("next", F.lead("first").over(order))
    rows = ends.mapInArrow(_borders, "part int, before int, after int").collect()  # three numbers a range
    return ranged, {r["part"]: (r["before"], r["after"]) for r in rows}


def _tries(borders: dict[int, tuple[int, int]]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part, trie = key[0].as_py(), Trie()
        before, after = borders[part]
        own = rows.select(["path", "n", "least", "ends"])
        smallest, largest = min(own.column("path").to_pylist()), max(own.column("path").to_pylist())
        for batch in own.to_batches(max_chunksize=BATCH):
            trie.insert(list(zip(*(c.to_pylist() for c in batch.columns))))
        found = [(part, *row) for row in trie.expanded(chain_of(smallest), chain_of(largest), before, after)]
        names = ["part", "key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return pa.Table.from_batches([_columns(found, names, [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()])])

    return run


def prefix_nodes(sequences: DataFrame, turns: int = TURNS) -> DataFrame:
    """A row per distinct beginning of the paths in ``sequences`` (``conv_id, path``), the empty one included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Without conversations there are no rows, not even a root.
    """
    ranged, borders = _ranges(_distinct(sequences), turns)
    nodes = stored(ranged.groupBy("part").applyInArrow(_tries(borders), NODE), "beginnings")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = nodes.where(F.col("key").isNull() & F.col("parent_key").isNull()).select(result)
    # Beginnings that ranges share: at most the turns of two paths a range.
    shared = nodes.where(F.col("key").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shared.groupBy("key").agg(F.first("parent_key", ignorenulls=True).alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    merged = merged.join(above, "parent_key", "left").select(result)
    # Their children inside a range meet them by range, so that a very common beginning is not one key.
    by_range = shared.select("part", F.col("key").alias("parent_key")).join(above, "parent_key")
    under = nodes.where(F.col("key").isNull() & F.col("parent_key").isNotNull()).drop("parent_conv_id").join(by_range, ["part", "parent_key"]).select(result)
    return whole.unionByName(merged).unionByName(under).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def conversation_prefixes(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """``prefix_nodes`` of the rebuilt conversations of a table ``conv_id, turn, role, text``.

    Turns stand in the order of ``turn``, null first; rows with equal turns in that of role, then of a digest of role and text. Null roles and
    texts are empty. Rows with a null ``conv_id`` belong to no conversation. Repeated rows are turns
    of their own. Other columns are not read; an empty table gives no rows. A conversation is one row of 20 bytes a turn.
    """
    return prefix_nodes(rebuilt(conversations), turns)
