"""The corpus operators against brute force, on fixtures and the small tables, and on odd rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from siftwork.llm import fmindex, minhash, packing, quality, simple8b, sketches, substrings, templates, token_counts, token_files, toxicity, warc
from siftwork.llm.queries import BPE
from siftwork.llm.tokens import Encoder
from siftwork.llm.worker import shingle_hashes, word_hashes
from tests.conftest import DATA
from tests.llm import cases

LIBRARY = Tokenizer.from_file(BPE)
QUERIES = entry.queries()


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")


# Token ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'sdaBéß1.,!\x1c日<|", max_size=40), max_size=6))
def test_cached_ids_are_the_librarys(texts):
    own = Encoder(BPE, 50)
    ids, at = own.encode(texts + ["a<|endoftext|> b", "it's  we'll "])
    for i, text in enumerate(texts + ["a<|endoftext|> b", "it's  we'll "]):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(text)
    assert own.lengths(texts).tolist() == [len(ids_of(x)) for x in texts]


def test_other_tokenizers_encode_whole_texts():
    words = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert not words.cached and not pieces.cached
    assert words.lengths(["The  heat", ""]).tolist() == [len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(x, add_special_tokens=False).ids) for x in ("The  heat", "")]
    assert pieces.lengths(["The heat", ""])[1] == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_simple8b_round_trip(values, a, b):
    block = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(block).tolist() == values
    assert simple8b.decode(block, min(a, b), max(a, b)).tolist() == values[min(a, b) : max(a, b)]


def test_simple8b_runs_and_refusal():
    assert len(simple8b.encode(np.full(100_000, 7))) < 60
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 40)


def test_token_files_of_odd_rows(spark, tmp_path):
    token_files.write_files(cases.odd_docs(spark), BPE, str(tmp_path / "files"))
    blocks = token_files.read_files(spark, str(tmp_path / "files"))
    rows = token_files.digests(blocks).collect()
    ordered = sorted(cases.ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for i, text in ordered:
        own = ids_of(text) + [2]
        expected.append((i, at, len(own), crc(own)))
        at += len(own)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    whole = {r["doc_id"]: r["ids"] for r in token_files.documents_of(blocks).where("doc_id = 35").collect()}
    assert whole[35] == ids_of(dict(cases.ROWS)[35]) + [2]


def test_token_counts_of_odd_rows(spark):
    rows = token_counts.count_tokens(cases.odd_docs(spark), BPE).collect()
    expected = Counter((i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 512) for i, t in cases.ROWS)
    assert Counter(map(tuple, rows)) == expected


def check_pieces(rows, expected, window=2048):
    """Each document's ids lie once in its pieces, sequences are gapless; returns padding and tokens."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert Counter({i: sum(r["length"] for r in p) for i, p in by_doc.items()}) == Counter({i: sum(map(len, x)) for i, x in expected.items()})
    for doc_id, pieces in by_doc.items():
        if len(expected[doc_id]) == 1:
            own, at = expected[doc_id][0], 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[at : at + r["length"]])
                at += r["length"]
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def expected_ids(rows):
    out = {}
    for i, t in rows:
        out.setdefault(i, []).append(ids_of(t) + [1])
    return out


def test_packing_of_odd_rows(spark):
    rows = packing.pack(cases.odd_docs(spark), BPE).collect()
    check_pieces(rows, expected_ids(cases.ROWS))
    assert all(crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] for r in rows)


def test_packing_wastes_little_and_keeps_order(spark, documents):
    rows = QUERIES["op5_packing"](spark, DATA).collect()
    expected = expected_ids(documents.items())
    padding = check_pieces(rows, expected)
    assert padding < 0.03 * sum(len(x[0]) for x in expected.values())
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert ordered == sorted(ordered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 9)), min_size=1, max_size=40))
def test_cuts_are_the_cheapest(steps):
    window = 8
    where = np.cumsum([0, *(a for a, _ in steps)])
    cost = np.array([0, *(c for _, c in steps)])
    cuts = packing.best_cuts(where, cost, window, last=False)
    best = [0] + [10**9] * len(steps)
    for j in range(1, len(best)):
        best[j] = min(best[i] + window - (where[j] - where[i]) + cost[j] for i in range(j) if where[j] - where[i] <= window)
    price = dict(zip(where.tolist(), cost.tolist()))
    edges = [0, *cuts]
    assert sum(window - (b - a) + price[b] for a, b in zip(edges, edges[1:])) == best[-1]


# Near duplicates and fingerprints


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_odd_rows(spark, width):
    rows = minhash.near_duplicates(cases.odd_docs(spark), width).collect()
    expected = components(cases.ROWS, width)
    sizes = Counter((i, len(cases.shingle_set(t, width))) for i, t in cases.ROWS)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in rows) == sizes
    for r in rows:
        assert r["component_id"] == (expected[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])


components = cases.components


def test_near_duplicates_of_the_small_table(spark, documents):
    rows = QUERIES["op1_near_duplicates"](spark, DATA).collect()
    expected = components(documents.items(), 2)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def test_members_away_from_their_centre_are_compared(spark):
    """A chain of near copies: neighbours are linked, ends are not, and blocks are smaller than the bucket."""
    base = cases.sentence(7, 200).split()
    rows = []
    for k in range(12):
        own = list(base)
        for c in range(k):
            for x in range(3):
                own[c * 15 + x * 5] = f"new{c}{x}"
        rows.append((k + 1, " ".join(own)))
    rows += [(100 + k, cases.sentence(50 + k)) for k in range(5)]
    before, minhash.BLOCK = minhash.BLOCK, 3
    try:
        found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(cases.odd_docs(spark, rows), 2).collect()}
    finally:
        minhash.BLOCK = before
    assert found == components(rows, 2)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    shared = 0
    for _ in range(40):
        x = r.integers(0, 2**48, 260, dtype=np.uint64)  # 200 and 210 of 260, 150 shared
        shared += (minhash.signature(x[:200]) == minhash.signature(x[50:])).mean() / 40
    assert abs(shared - 150 / 260) < 0.06


def test_fingerprints_of_odd_rows(spark):
    rows = sketches.fingerprints(cases.odd_docs(spark)).collect()
    assert len(rows) == len(cases.ROWS)
    ordered = sorted(((i, t or "") for i, t in cases.ROWS), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    expected = Counter()
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 3
        other = text[: len(text) - n] + following[:n]
        own = sketches.sketch(text)
        near = [sketches.resemblance(own, sketches.sketch(x)) for x in (other, following)]
        expected[(i, len(text), hashlib.sha256(other.encode()).hexdigest(), sketches.text_of(own), sketches.text_of(sketches.sketch(other)), *near)] += 1
    assert Counter(map(tuple, rows)) == expected


def test_sketches_merge_and_estimate():
    a, b = cases.LONG, " ".join(cases.LONG.split()[5000:] + cases.sentence(9, 5000).split())
    x, y = sketches.sketch(a), sketches.sketch(b)
    assert (sketches.sketch_of(sketches.text_of(x)) == x).all()
    true = lambda u, v: len(u & v) / len(u | v)
    sets = [cases.shingle_set(t, 5) for t in (a, b)]
    assert abs(sketches.resemblance(x, y) - true(*sets)) < 0.15
    assert abs(sketches.distinct_shingles(x) / len(sets[0]) - 1) < 0.3
    assert abs(sketches.containment(x, y) - len(sets[0] & sets[1]) / len(sets[0])) < 0.25
    half = a.split()
    parts = [sketches.sketch(" ".join(half[:9000])), sketches.sketch(" ".join(half[8996:]))]
    assert (sketches.merge(parts) == x).all()


# Repeated passages


def test_index_finds_first_places():
    r = np.random.default_rng(3)
    text = np.append(r.integers(1, 4, 400), 0)
    places = np.arange(390)
    first = fmindex.FMIndex(text).repeats(text, places, 6)
    seen = {}
    assert first.tolist() == [seen.setdefault(tuple(text[p : p + 6]), p) for p in places]


def removal_of(rows):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows if r["doc_id"] is not None}


def expected_removal(rows):
    kept = cases.without_repeats(rows)
    return {i: (len(cases.words(t)), len(cases.words(t)) - len(kept[i]), hashlib.sha256(" ".join(kept[i]).encode()).hexdigest()) for i, t in rows if i is not None}


def test_substrings_of_odd_rows(spark):
    rows = substrings.removal_digests(cases.odd_docs(spark)).collect()
    assert len(rows) == len(cases.ROWS) and removal_of(rows) == expected_removal(cases.ROWS)
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)


def test_substrings_of_the_small_table(spark, documents):
    assert removal_of(QUERIES["op6_substrings"](spark, DATA).collect()) == expected_removal(list(documents.items()))


def test_crowded_anchors_are_cut_into_windows(spark):
    line = cases.sentence(11, 24)
    rows = [(k, f"{cases.sentence(200 + k, 30)} {line} {cases.sentence(400 + k, 30)}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = substrings.repeated_windows(docs, crowd=2, shard=500).collect()
    found = {(r["doc_id"], r["start"] + k) for r in runs for k in range(r["windows"])}
    seen, expected = {}, set()
    for i, t in rows:
        own = t.split()
        for k in range(len(own) - 19):
            if seen.setdefault(tuple(own[k : k + 20]), (i, k)) != (i, k):
                expected.add((i, k))
    assert found == expected


def test_copies_of_crowded_windows_do_not_meet_in_a_shard(spark, monkeypatch):
    line = cases.sentence(11, 24)
    rows = [(k, f"{cases.sentence(200 + k, 30)} {line} {cases.sentence(400 + k, 30)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    searched = substrings._searched

    def limited(batches):
        for batch in batches:
            assert max(Counter(batch.column("shard").to_pylist()).values()) <= 20
            yield from searched(iter([batch]))

    monkeypatch.setattr(substrings, "_searched", limited)
    found = {(r["doc_id"], r["start"] + k) for r in substrings.repeated_windows(docs, crowd=10, shard=500).collect() for k in range(r["windows"])}
    seen = {}
    assert found == {(i, k) for i, t in rows for k in range(65) if seen.setdefault(tuple(t.split()[k : k + 20]), (i, k)) != (i, k)}


def test_shortened_leaves_other_texts_alone(spark):
    docs = cases.odd_docs(spark)
    out = substrings.shortened(docs)
    assert out.columns == docs.columns
    rows = out.where("doc_id in (20, 24, 35)").collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {i: t for i, t in cases.ROWS if i in (20, 24, 35)}


# Benchmark passages

ITEM = "Maria sold 48 apples to her friends in April and then she sold half as many apples in May at 3 dollars each"


def test_templates_catch_changed_slots(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (None, ITEM)], "item_id long, text string")
    other = ITEM.replace("48", "96").replace("3 dollars", "7 euros").replace("April", "June")
    torn = ITEM.replace("apples", "pears", 1)
    rows = [
        (1, "some text before. " + ITEM + " and after"), (2, "so it was said that " + other), (3, cases.sentence(5)), (4, None), (5, ""),
        (6, " ".join(ITEM.split()[:9])), (7, "we know " + torn), (8, "it is " + ITEM.replace("April", "Maria")),
    ]
    docs = cases.odd_docs(spark, rows)
    found = {r["doc_id"]: r for r in templates.contamination(docs, benchmark).collect()}
    assert {i for i, r in found.items() if r["contaminated"]} >= {1, 2} and not any(found[i]["contaminated"] for i in (3, 4, 5, 6))
    assert found[1]["item_ids"] == [1] and found[1]["matches"][0]["length"] == len(ITEM.split())
    kept = templates.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and {3, 4, 5, 6} <= {r["doc_id"] for r in kept.collect()}
    several = templates.with_matches(docs, benchmark.union(spark.createDataFrame([(9, cases.sentence(5))], "item_id long, text string")), block_bytes=40).collect()
    assert {r["doc_id"] for r in several if r["matches"]} >= {1, 2, 3}


def test_texts_matched_together_share_no_window():
    """Many texts at once give what each gives alone, and array operations are not paid per text."""
    own, item = templates.Templates(), templates.Benchmark([(4, ITEM), (5, "we know that")])
    words = ITEM.split()
    texts = [" ".join(words[:7]), " ".join(words[7:]), "", "we know that", "x " + ITEM, "we know", "that " + ITEM + " y", ITEM] * 3
    made = []
    windows = templates.Tokens.windows
    try:
        templates.Tokens.windows = lambda self: made.append(len(self)) or windows(self)
        together = item.matches_of(texts, own)
    finally:
        templates.Tokens.windows = windows
    assert together == [item.matches(x, templates.Templates()) for x in texts] and any(together)
    assert len(made) == 1


def test_slots_must_be_filled_consistently():
    own = templates.Templates()
    text = "On Monday the 12 boys gave 12 coins to the 7 girls who then gave 7 coins back to the 12 boys again"
    item = templates.Benchmark([(4, text)])
    assert item.matches(text.replace("12", "30"), own)
    assert not item.matches(text.replace("12", "30", 1), own)
    assert not item.matches(text.replace("12", "7"), own)


def test_inconsistent_runs_are_split_at_the_clash():
    own = templates.Templates()
    text = "We know that 12 boys gave the 7 girls coins and then they went home to sleep because it was late and all 12 of them were quite tired after the long day"
    item = templates.Benchmark([(4, text)])
    assert item.matches(text.replace("12", "30", 1), own) == [(4, 0, 23), (4, 4, 29)]
    assert item.matches(text.replace("12", "30").replace("7", "30"), own) == [(4, 4, 19), (4, 8, 25)]
    short = " ".join(text.split()[:16])
    assert templates.Benchmark([(4, short)]).matches(short.replace("7", "12"), own) == []


def test_copies_made_mostly_of_slots_are_found():
    own = templates.Templates()
    text = "add 12 and 31 and 45 6 77 8 90 km 13 14 kg and 15 16 17 Paris London Rome"
    item = templates.Benchmark([(4, text)])
    assert item.matches(f"so we {text} today", own) == [(4, 2, len(text.split()))]
    assert item.matches(f"so we {text} today".replace("12", "21"), own) == [(4, 4, len(text.split()) - 2)]
    assert item.matches("so we add 2 and 3 and 4 60 7 80 9 km 103 104 kg and 105 106 107 Oslo Wien Bonn today", own) == []


def test_names_at_the_start_of_a_sentence_may_change():
    own = templates.Templates()
    text = "Alice has 5 apples. Bob gives Alice 3 apples. How many apples does Alice have now?"
    item = templates.Benchmark([(4, text)])
    other = text.replace("Alice", "Carol").replace("Bob", "Dave").replace("5", "9").replace("3", "4")
    assert item.matches(other, own) == [(4, 0, 16)]
    assert item.matches("so then " + other.replace(".", ""), own) == [(4, 2, 16)]
    assert item.matches("so then " + text.replace(".", ""), own) == [(4, 2, 16)]
    assert item.matches(other.replace("gives Carol", "gives Emma"), own) == []
    many = "Anna. Berta. Clara. Doris. Emma. Flora. Greta. Helga."
    at = own.of(f"we {many}".split()).windows()[1]
    assert sorted(at.tolist()) == [0] * 64 + [1] * 128


def test_short_items_are_found_as_exact_copies(spark):
    own = templates.Templates()
    find = lambda item, text: templates.Benchmark([(4, item)]).matches(text, own)
    eight, ten = "The boy sold his old bike to Anna.", "the boy sold his old red bike to our Anna"
    for item in (eight, ten):
        n = len(item.split())
        for text in (f"Heading\n{item} And more", f"she said {item}", f"Heading \u201c{item[0].upper()}{item[1:]}\u201d", item):
            assert [m[2] for m in find(item, text)] == [n]
    assert find(ten, "Heading Bob" + ten[3:]) == []
    assert find("What is two plus two?", "So: what is two plus two, then") == [(4, 1, 5)] and find("What is two plus two?", "what is two plus three") == []
    assert find("Why?", "Why") == [(4, 0, 1)] and find("- ?!", "a - ?! b") == []
    assert find("\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3002", "ab \u4f55\u6771\u4eac\u306f\u65e5\u672c \u306e\u9996\u90fd\u3067\u3059\u3002 c") == [(4, 1, 2)]
    assert find("\u0e01\u0e34\u0e19", "\u0e02\u0e49\u0e32\u0e27\u0e01\u0e34\u0e19\u0e02\u0e49\u0e32\u0e27") == [(4, 0, 1)] and find("\u0e01\u0e34\u0e19", "\u0e01\u0e19") == []
    docs = spark.createDataFrame([(1, "two words"), (2, "two of words")], "doc_id long, text string")
    rows = templates.contamination(docs, spark.createDataFrame([(7, "Two words!")], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in rows} == {1: [7], 2: []}


def test_contamination_of_the_small_table(spark, documents):
    import re

    plain = lambda x: " " + " ".join(re.findall(r"\w+", x.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    expected = {i for i, t in documents.items() if any(x in plain(t) for x in items)}
    assert {r["doc_id"] for r in QUERIES["op7_decontamination"](spark, DATA).where("contaminated").collect()} == expected


# Revisits


def test_revisits_take_the_latest_earlier_response(spark):
    page = lambda i, kind, uri, ts, status, headers, digest: (i, kind, uri, ts, status, headers, digest, 10, "x")
    rows = [
        page(1, "response", "http://www.a.org/x/", 10, 200, {"etag": '"1"', "content-type": "text/html"}, "d1"),
        page(2, "response", "https://a.org/x#top", 20, 200, {"etag": '"2"', "date": "20"}, "d2"),
        page(3, "response", "https://a.org/x", 25, 500, {"etag": '"3"'}, "d3"),
        page(4, "revisit", "https://A.org/x?utm_source=y", 30, 304, {"etag": 'W/"2"', "date": "30", "content-type": "bad"}, None),
        page(5, "revisit", "https://a.org/x", 15, 304, {"etag": '"2"'}, None),
        page(6, "revisit", "https://a.org/x", 20, 304, {}, "d1"),
        page(7, "revisit", "https://a.org/x", 5, 304, {"etag": '"1"'}, None),
        page(8, "revisit", None, 40, 304, None, None),
        page(9, "revisit", "https://a.org/x", None, 304, {"etag": '"2"'}, None),
        page(10, "revisit", "https://a.org/x", 40, 304, {}, None),
        page(10, "revisit", "https://a.org/x", 40, 304, {}, None),
        page(11, "request", "https://a.org/x", 40, 200, {}, None),
        page(None, "revisit", "https://b.org", 40, 304, {}, None),
    ]
    records = spark.createDataFrame(rows, warc.RECORDS + ", part string")
    out = warc.resolve(records).collect()
    assert len(out) == 9
    found = {r["record_id"]: r for r in out}
    assert {i: (r["resolution"], r["response_id"]) for i, r in found.items()} == {
        4: ("resolved", 2), 5: ("mismatch", 1), 6: ("resolved", 1), 7: ("missing", None), 8: ("missing", None), 9: ("missing", None), 10: ("unvalidated", 2), None: ("missing", None),
    }
    assert found[4]["headers"] == {"etag": 'W/"2"', "date": "30"} and found[6]["headers"]["content-type"] == "text/html"
    assert warc.resolve(records.limit(0)).collect() == []


# Classifiers


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("score, column", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, labels, score, column):
    docs = cases.odd_docs(spark)
    rows = score(docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in cases.ROWS)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert len(score(docs, labels.limit(0)).collect()) == len(rows)
    assert score(docs.limit(0), labels).collect() == []


def test_labels_of_the_held_out_fold_are_not_learned(spark, labels):
    docs = cases.odd_docs(spark)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(map(str, score(docs, labels).collect())) == sorted(map(str, score(docs, turned).collect()))


@pytest.mark.parametrize("name, column, least", [("op3_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, column, least):
    folder = DATA.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, folder).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= least


def test_accepted_keeps_rows_as_they_are(spark):
    docs = cases.odd_docs(spark)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns and not {22, 23, 24} & {r["doc_id"] for r in out.collect()}


# All of them


OPERATORS = {
    "near_duplicates": lambda d, s: minhash.near_duplicates(d), "files": lambda d, s: token_files.encode_files(d, BPE), "fingerprints": lambda d, s: sketches.fingerprints(d), "pack": lambda d, s: packing.pack(d, BPE),
    "substrings": lambda d, s: substrings.shortened(d), "first": lambda d, s: minhash.first_of_each(d), "templates": lambda d, s: templates.decontaminated(d, s.createDataFrame([], "item_id long, text string")), "counts": lambda d, s: token_counts.count_tokens(d, BPE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](cases.odd_docs(spark, []), spark).collect() == []


def test_shingles_of_few_words():
    assert len(shingle_hashes(word_hashes([b"a", b"b"]), 5)) == 1 and len(shingle_hashes(word_hashes([]), 5)) == 0


def test_token_queries_on_the_small_table(spark, documents):
    at, expected = 0, {}
    for i in sorted(documents):
        own = ids_of(documents[i]) + [2]
        expected[i] = (at, len(own), crc(own))
        at += len(own)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op2_token_files"](spark, DATA).collect()} == expected
    counts = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_token_counts"](spark, DATA).collect()}
    assert counts == {i: n - 1 for i, (_, n, _) in expected.items()}
    assert QUERIES["op4_fingerprints"](spark, DATA).count() == len(documents)


def test_stages_of_the_pipeline(spark):
    """Every stage's decision on the small table, from its own input, by brute force."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        rows = out.collect()
        if name == "quality_classifier":
            scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, p in scores.items() if p}
        elif name == "near_dedup":
            found = components([(i, r["text"]) for i, r in before.items()], 5)
            assert sorted(r["doc_id"] for r in rows) == sorted(set(found.values()))
        elif name == "substring_dedup":
            expected = cases.without_repeats([(i, r["text"]) for i, r in before.items()])
            assert {r["doc_id"]: cases.words(r["text"]) for r in rows} == expected
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "benchmark_decontamination":
            flagged = {r["doc_id"] for r in templates.contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
            assert {r["doc_id"] for r in rows} == before.keys() - flagged
        else:
            check_pieces(rows, expected_ids([(i, r["text"]) for i, r in before.items()]))
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = len(rows)
        docs = spark.createDataFrame(rows, out.schema)
    assert len(kept) == 4


def test_revisits_agree_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    cursor = con.execute(entry.oracle_sql()["op8_revisits"])
    names = [c[0] for c in cursor.description]
    rows = [tuple(r[c] for c in names) for r in QUERIES["op8_revisits"](spark, DATA).collect()]
    assert sorted(rows) == sorted(cursor.fetchall())
