"""Words, anchors and segments of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siftwork.llm import substrings


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_words_of_many_texts_are_hashed_together(monkeypatch):
    monkeypatch.setattr(substrings, "HASHED", 300)
    alone = []
    digest = substrings.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(substrings.xxhash, "xxh3_64_intdigest", lambda x: alone.append(x) or digest(x))
    texts = ["the cat\tsat\x0bon", None, "", "  \n", "é the " * 40, "cat\x1con \xa0 the", "x" * 400 + " the " + "x" * 400, "on"]
    words, bounds = substrings.words_of(batch(texts))
    expected = [(x or "").encode().split() for x in texts]
    assert np.diff(bounds).tolist() == [len(x) for x in expected]
    flat = [w for x in expected for w in x]
    assert len(set(words.tolist())) == len(set(flat)) == len(set(zip(words.tolist(), flat)))
    assert alone == [b"x" * 400] * 2


def test_the_least_of_each_run_is_the_first_of_equal_ones():
    values = np.random.default_rng(5).integers(0, 9, 500).astype(np.uint64)
    for width in (1, 2, 7, 16):
        assert substrings.least(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(len(values) - width + 1)]


def test_segments_of_a_text_do_not_depend_on_those_beside_it():
    r = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 30, n)) for n in (19, 20, 0, 300, 5, 24, 21)]

    def cut(some):
        words, bounds = substrings.words_of(batch(some))
        anchor, owner, first, count = substrings.segments(words, bounds)
        digest = substrings.digests(words, first, first + count + substrings.WINDOW - 1)
        return [(a, o, f, n, d) for a, o, f, n, d in zip(anchor.tolist(), owner.tolist(), (first - bounds[owner]).tolist(), count.tolist(), digest.tolist())]

    together = cut(texts)
    assert together == [(a, i, f, n, d) for i, x in enumerate(texts) for a, _, f, n, d in cut([x])]
    assert sum(n for _, _, _, n, _ in together) == sum(max(0, len(x.split()) - 19) for x in texts)
