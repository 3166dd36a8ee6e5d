"""Piece ids, source spans and decoded texts against the library itself, also under models with a character map."""

import hashlib
from collections import Counter
from functools import lru_cache

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from siftwork.llm import pieces
from siftwork.llm.queries import PIECE_BPE
from tests.conftest import DATA
from tests.llm import cases

with open(PIECE_BPE, "rb") as f:
    MODEL = f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
SETTINGS = ["own", "nmt_nfkc", "nfkc_cf", "keeps blanks", "no prefix", "no bytes"]
ODD = st.text(alphabet=" 　 \t\n\x00\x01aBéß½ﬁｱﾞ日한ऐ́̈▁<0x9>𓀀ǅ", max_size=30)


def rules(name):
    return next(v for n, v in pieces.message(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()) if n == pieces.NORMALIZER)


@lru_cache
def model(kind):
    field = pieces._field
    if kind == "own":
        return MODEL
    if kind == "no bytes":  # byte pieces become unused ones: unknown characters stay unknown
        made = []
        for n, v in pieces.message(MODEL):
            if n == pieces.PIECE and dict(pieces.message(v)).get(pieces.PIECE_TYPE) == pieces.BYTE:
                v += field(pieces.PIECE_TYPE, pieces.UNUSED)
            elif n == pieces.TRAINER:
                v += field(35, 0)
            made.append(field(n, v))
        return b"".join(made)
    spec = rules("nmt_nfkc" if kind in ("keeps blanks", "no prefix") else kind)
    spec += field(pieces.REMOVE_EXTRA, 0) if kind == "keeps blanks" else b""
    spec += field(pieces.DUMMY_PREFIX, 0) if kind == "no prefix" else b""
    return pieces.with_normalizer(MODEL, spec)


@lru_cache
def both(kind):
    return pieces.Pieces(model(kind), 30), sentencepiece.SentencePieceProcessor(model_proto=model(kind))


def spans_of(library, text):
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("kind", SETTINGS)
@settings(max_examples=150, deadline=None)
@given(text=ODD)
def test_ids_and_spans_are_the_librarys(kind, text):
    own, library = both(kind)
    ids, starts, ends = own.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert list(zip(starts.tolist(), ends.tolist())) == spans_of(library, text)


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.one_of(ODD, st.text(alphabet=" abc", max_size=20)), max_size=6))
def test_texts_of_a_batch_do_not_touch_each_other(texts):
    own, library = both("own")
    found = own.encode(texts)
    assert [x[0].tolist() for x in found] == [library.encode(t) for t in texts]
    assert [list(zip(x[1].tolist(), x[2].tolist())) for x in found] == [spans_of(library, t) for t in texts]


@pytest.mark.parametrize("name", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_is_read_whole(name):
    spec = dict(pieces.message(rules(name)))
    found = pieces.character_map(spec[pieces.CHARACTER_MAP])
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=name)
    listed = normalizer.decompile()
    assert len(found) == len(listed) > 1000


def test_spans_join_to_the_text():
    own, _ = both("own")
    for _, text in cases.ROWS:
        raw = (text or "").encode()
        ids, starts, ends = own.encode([text or ""])[0]
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw


def rows_of(rows):
    out = Counter()
    for i, text in rows:
        ids = LIBRARY.encode(text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids) if ids else "")]
        out[(i, len(ids), *digests, len((text or "").encode()))] += 1
    return out


def test_round_trip_of_odd_rows(spark):
    docs = cases.odd_docs(spark, [*cases.ROWS, (50, "x" * 300_000), (51, " " * 3000)])
    expected = {(i, t or "") for i, t in [*cases.ROWS, (50, "x" * 300_000), (51, " " * 3000)]}
    encoded = pieces.encode(docs, PIECE_BPE)
    assert Counter(r["doc_id"] for r in encoded.collect()) == Counter(i for i, _ in [*cases.ROWS, (50, 0), (51, 0)])
    apart = Counter(map(tuple, pieces.decode(encoded, PIECE_BPE).collect()))
    assert set(apart) == {(i, LIBRARY.decode(LIBRARY.encode(t)) if t else "") for i, t in expected}
    fused = pieces.round_trip(docs, PIECE_BPE)
    assert Counter((r["doc_id"], r["decoded"]) for r in fused.collect()) == apart
    assert pieces.round_trip(docs.limit(0), PIECE_BPE).collect() == []
    assert [tuple(r) for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECE_BPE).collect()] == [(1, "")]


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, entry.queries()["op13_pieces"](spark, DATA).collect())) == rows_of(rows)
