"""Ids that stand for several texts, and counts behind the toxicity classifier."""

from collections import Counter

from siftwork.llm import labelled, minhash, toxicity
from tests.llm import cases

A, B = cases.sentence(41), cases.sentence(42)


def test_links_of_every_text_of_an_id_are_found(spark):
    rows = [(5, A), (5, B), (8, A + " word"), (9, B + " word"), (9, B + " word"), (7, cases.sentence(43))]
    out = minhash.near_duplicates(cases.odd_docs(spark, rows), 2).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in out) == Counter([(5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False), (9, 5, False), (7, 7, True)])


def test_texts_of_an_id_may_lie_in_different_components(spark):
    rows = [(5, A), (5, B), (3, A + " word"), (9, B + " word")]
    out = minhash.near_duplicates(cases.odd_docs(spark, rows), 2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_different_texts_of_an_id_are_kept(spark):
    rows = [(5, A), (5, A), (5, B), (5, A + " word"), (9, B + " word"), (6, None), (6, ""), (6, ""), (None, A), (None, A)]
    docs = cases.odd_docs(spark, rows)
    out = minhash.first_of_each(docs, 2)
    found = Counter((r["doc_id"], r["text"]) for r in out.collect())
    a = found.pop((5, A), 0) + found.pop((5, A + " word"), 0)
    assert out.columns == docs.columns and a == 1
    assert found == Counter({(5, B): 1, (6, None): 1, (6, ""): 1, (None, A): 2})


def test_features_are_counted_over_all_documents_that_may_be_learned_from(spark, monkeypatch):
    rows = [(i, f"Common word{'' if i % 3 else ' insulting insulted'} {'x' * (i % 4)}") for i in range(40)] + [(None, "common"), (41, None), (42, "")]
    expected = Counter()
    for i, text in rows:
        if i is not None and not spark.range(1).select(labelled.held_out(toxicity.F.lit(i))).first()[0]:
            expected.update(toxicity.features(text or "") | {""})
    for held in (toxicity.HELD, 3):
        monkeypatch.setattr(toxicity, "HELD", held)
        assert {r["feature"]: r["u"] for r in toxicity.counted(cases.odd_docs(spark, rows)).collect()} == expected


def test_the_prior_needs_no_sorted_labels(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (4, None), (4, 1)], "doc_id long, toxic int")
    plan = labelled.all_fitting_labels(labels, "toxic")._jdf.queryExecution().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "Sort [" not in plan
    assert {r["doc_id"]: r["label"] for r in labelled.all_fitting_labels(labels, "toxic").collect()}.get(4, 1) == 1
