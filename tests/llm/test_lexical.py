"""Ranked search against brute force on odd rows, and the query-sharing graph against separate sums."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from siftwork.llm import lexical
from tests.conftest import DATA
from tests.llm import cases

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    documents, total = len(bags), sum(n for _, _, n in bags)
    holding = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * documents) // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ITEMS = [(1, cases.BASE[:90]), (1, cases.BASE[:90]), (2, cases.BASE[:90]), (None, "One TWO same"), (3, None), (4, ""), (5, "... --"), (6, "nosuchterm"), (7, "日本語 x same same same"), (8, cases.sentence(2)), (9, " ".join(cases.sentence(100 + i, 500) for i in range(3)))]


def test_ranks_of_odd_rows(spark, monkeypatch):
    docs = cases.odd_docs(spark)
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, query string, rank string")
    expected = ranked(cases.ROWS, ITEMS)
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == expected
    # Several blocks of items, few accumulators at a time, texts cut into many parts: the same rows.
    monkeypatch.setattr(lexical, "BLOCK", 2000)
    monkeypatch.setattr(lexical, "CELLS", 1)
    monkeypatch.setattr(lexical, "STRIDE", 7)
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == expected
    assert Counter(map(tuple, lexical.search(docs, items, 2).collect())) == ranked(cases.ROWS, ITEMS, 2)


def test_empty_tables(spark):
    docs, items = cases.odd_docs(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert Counter(map(tuple, entry.queries()["op11_ranked_search"](spark, DATA).collect())) == ranked(docs, items)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e", b"f", b"g"]), min_size=1, max_size=12), min_size=1, max_size=12), st.integers(0, 2**31))
def test_shared_sums_are_the_separate_sums(items, seed):
    bags = [Counter(x) for x in items]
    graph = lexical.Graph(bags)
    worth = np.random.default_rng(seed).integers(0, 1000, (len(graph.numbers), 3))
    found = graph.scores(worth)
    assert found.tolist() == [[sum(n * int(worth[graph.numbers[t], d]) for t, n in bag.items()) for d in range(3)] for bag in bags]
    assert graph.additions <= graph.additions_apart


def test_common_sets_are_added_up_once(spark):
    common = Counter(terms(cases.BASE))
    graph = lexical.Graph([common + Counter([f"own{i}"]) for i in range(50)])
    assert graph.additions < graph.additions_apart / 10
    items = [Counter(terms(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    graph = lexical.Graph(items)
    assert graph.additions < graph.additions_apart


@pytest.mark.parametrize("k", [1, 3])
def test_best_keeps_ties_in_order(k):
    best = lexical.Best(1, k)
    for i in (5, 3, 9, 1):
        best.add(np.array([[7]]), np.array([i]), np.array([False]))
    best.add(np.array([[7]]), np.array([0]), np.array([True]))
    assert best.settle()[2].tolist() == [1, 3, 5][:k]
