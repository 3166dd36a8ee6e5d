"""How much an encoder holds."""

from __future__ import annotations

import tracemalloc

from siftwork.llm.queries import BPE
from siftwork.llm.tokens import Encoder


def test_encoding_holds_few_bytes_an_id():
    own = Encoder(BPE)
    texts = [" ".join("abcdefgh"[i % 8] for i in range(100_000))] * 10
    expected = own.whole(texts[0])
    own.encode(texts[:1])
    tracemalloc.start()
    try:
        ids, at = own.encode(texts)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(ids) == 10 * len(expected) and at.tolist() == [i * len(expected) for i in range(11)]
    assert (ids[at[9] :] == expected).all()
    assert peak < 24 * len(ids)


def test_pieces_are_kept_in_half_the_room_of_items():
    own = Encoder(BPE, 10)
    assert (own.items.limit, own.pieces.limit) == (10, 5)


def test_new_words_are_merged_many_at_a_time(monkeypatch):
    own = Encoder(BPE)
    alone = []
    one_by_one = own._merged
    monkeypatch.setattr(own, "_merged", lambda piece: alone.append(piece) or one_by_one(piece))
    words = [f"{a}{b}{c}{end}" for a in ("the", "Über", "ÿ", "it's") for b in ("12", "a\nb", "--", "ß") for c in ("ing", "\t9", "!?") for end in ("", ".", ",")]
    texts = [" ".join(words), words[0], " ".join(reversed(words))]
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.whole(x).tolist() for x in texts]
    assert not alone


def test_items_that_cannot_be_cut_together_are_right():
    texts = ["", " ", "  a", "a  b", "\r", "a\rb c\r", "a\r\nb", "\nfoo bar", "x <|endoftext|> y", "日本 語", "a\x00b", "The cat", "b The", "a b", "a\xa0b c", "a\x1c b", "12 3a4 ½", "don't\nI'll"]
    for limit in (3, 1000):
        own = Encoder(BPE, limit)
        for _ in range(2):
            ids, at = own.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.whole(x).tolist() for x in texts]
            assert own.lengths(texts, {"b": 1, "cat": 1}).tolist() == [len(own.whole(x)) for x in texts]


def test_items_are_bounded_and_stay_right():
    own = Encoder(BPE, 50)
    for k in range(30):
        text = " ".join(f"w{i}x{i % 7}" for i in range(k * 10, k * 10 + 40))
        ids, _ = own.encode([text])
        assert ids.tolist() == own.whole(text).tolist()
        assert len(own.items.sizes) == len(own.items.keys) < 100 and own.items.sizes.sum() == len(own.items.pool)
