"""Beginnings of conversations against brute force, with many small ranges, and the trie's search."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from siftwork.llm import prefix_trie
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(a, b):
    return a % b if a >= 0 else -(-a % b)


def rebuilt(rows):
    """conv_id to its rebuilt turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - remainder(c, 20), [])[:h] + x[h:]
    return out


def expected(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        words = len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node] if node in children else 1
            saved[node[:d]] += (len(convs) - 1) * words
    return Counter(
        (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, convs in members.items()
    )


def rows():
    out = []
    for c in list(range(0, 70)) + [2**40, 2**40 + 1, -3, -20, -23, 4095, 4096, 4097, 9000]:
        for t in range(c % 7 if c != 20 else 0):
            # A third shares its first turn, some share more, some are copies.
            text = "the same first turn" if t == 0 and c % 3 == 0 else f"turn {t} of {c // 10 if t < 3 else c % 4}"
            out.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    out += [(200 + i, t, "user", f"copy {t}") for i in range(20) for t in range(5)]
    out += [(300, t, "user", "again") for t in range(150)] + [(301, t, "user", "again" if t < 140 else "else") for t in range(150)]
    out += [(400, None, None, None), (400, None, "user", None), (400, 1, None, "x  y\tz"), (400, 1, None, "x  y\tz"), (400, 1, "b", "q"), (400, 1, "a", "q"), (400, 1, "a", "p"), (401, None, None, ""), (402, 3, "", "")]
    out += [(None, 1, "user", "nobody's"), (500, 1, "use", "rx"), (501, 1, "user", "x"), (502, 1, "user", "日本 語\x1cx")]
    return out


@pytest.mark.parametrize("turns", [3, 40, 50_000])
def test_beginnings_of_odd_rows(spark, turns):
    own = rows()
    table = spark.createDataFrame([(*r, "x", "y") for r in own], "conv_id long, turn long, role string, text string, path string, seq string").repartition(5)
    found = prefix_trie.conversation_prefixes(table, turns).collect()
    assert Counter(map(tuple, found)) == expected(rebuilt(own))


def test_no_conversations(spark):
    table = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_prefixes(table).collect() == []
    assert prefix_trie.conversation_prefixes(table.limit(0)).collect() == []
    assert prefix_trie.conversation_prefixes(table).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_turnless_conversations_stand_at_the_root(spark):
    """Those whose own turns are all replaced, and whose base isn't there."""
    ids = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:5]
    table = spark.createDataFrame([(c, 0, "user", "hello") for c in ids], "conv_id long, turn long, role string, text string")
    found = prefix_trie.conversation_prefixes(table).collect()
    assert [tuple(r) for r in found] == [(ids[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_small_table(spark):
    own = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, entry.queries()["op12_conversation_prefixes"](spark, DATA).collect())) == expected(rebuilt(own))


def path_of(letters):
    return b"".join(bytes([c]) * 16 + (c).to_bytes(4, "big") for c in letters)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.lists(st.integers(1, 3), max_size=12).map(tuple), min_size=1, max_size=30), st.integers(1, 7))
def test_trie_of_random_paths(found, batch):
    trie, own = prefix_trie.Trie(), sorted(found, key=hash)
    for at in range(0, len(own), batch):
        trie.insert([(path_of(x), 1, i + at, "") for i, x in enumerate(own[at : at + batch])])
    every = {x[:d] for x in found for d in range(len(x) + 1)}
    chains = {tuple(c): x for x in every for c in [[prefix_trie.chain_of(path_of(x))[-1]]]}
    first, last = (prefix_trie.chain_of(path_of(f(found))) for f in (min, max))
    rows = list(trie.expanded(first, last, len(first) - 1, len(last) - 1))
    assert len(rows) == len(every)
    # Keys are given out for the prefixes of the first and the last path only.
    assert {chains[(r[0],)] for r in rows if r[0] is not None} == {x[:d] for x in (min(found), max(found)) for d in range(len(x) + 1)}
    # Every inserted path is found again: it ends exactly at its node, which lies under its two-fattest handle.
    for x in found:
        chain = prefix_trie.chain_of(path_of(x))
        node, leaving = trie.locate(chain)
        assert node is leaving and node.end == len(x) and node.chain[node.end] == chain[-1]
    for handle, node in trie.handles.items():
        assert handle == node.handle()


def test_search_is_logarithmic_in_turns():
    trie = prefix_trie.Trie()
    deep = [1] * 4000
    trie.insert([(path_of(deep[: 2 * i + 1]), 1, i, "") for i in range(2000)])
    trie.probes = 0
    node, _ = trie.locate(prefix_trie.chain_of(path_of([*deep[:3001], 2, 2])))
    assert node.end == 3001 and trie.probes <= 12


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert prefix_trie.fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)
