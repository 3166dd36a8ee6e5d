"""The words and beginnings of many texts at once, against those of each text alone."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from siftwork.llm import toxicity
from tests.llm import cases

TEXTS = [
    "", "  \n", "Idiot idiots IDIOTIC idiotically, idiot!", "a1b2_c-d insult's insulting insulted insulter insults", "ΟΔΥΣΣΕΥΣ ΣΑΣ ΣΑΣ\x1cσας Σ",
    "İstanbul Straße STRASSE ﬁnal ²² Ⅷth ½half", "漢字" * 200, "x yelling yelled\x85yells_yell٣yeller", "abcdefgh abcdefgi abcdefg abcdef abcde abcd abc" + " abcdz" * 3,
]


def scored_alone(weights: dict[str, float], bias: float, text: str) -> float:
    total = bias + math.fsum(weights[f] for f in toxicity.features(text) if f in weights)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_scores_of_many_texts_are_those_of_each(monkeypatch):
    features = sorted(set().union(*map(toxicity.features, TEXTS)))
    weights = dict(zip(features[::2], np.random.default_rng(5).normal(0, 1, len(features)).tolist()))
    expected = [scored_alone(weights, -0.5, x) for x in TEXTS]
    for held in (toxicity.HELD, 2):
        monkeypatch.setattr(toxicity, "HELD", held)
        own = toxicity.Linear(weights, -0.5)
        assert own.scores(TEXTS) == expected and own.scores(TEXTS[::-1]) == expected[::-1]
        assert [own.score(x) for x in TEXTS] == expected and own.scores([]) == []


def test_counts_of_many_texts_are_those_of_each(spark, monkeypatch):
    rows = [(i, x) for i, x in enumerate(TEXTS * 3)]
    expected = Counter()
    for i, text in rows:
        if not spark.range(1).select(toxicity.held_out(toxicity.F.lit(i))).first()[0]:
            expected.update(toxicity.features(text) | {""})
    for held, characters in ((toxicity.HELD, 16), (2, 16), (toxicity.HELD, 0)):
        monkeypatch.setattr(toxicity, "HELD", held)
        monkeypatch.setattr(toxicity, "CHARACTERS", characters)
        assert {r["feature"]: r["u"] for r in toxicity.counted(cases.odd_docs(spark, rows)).collect()} == expected


def test_a_word_is_looked_into_once():
    """Known words cost a look-up: their beginnings and weights are not worked out anew for every text."""
    own = toxicity.Linear({"insult-": 1.0, "idiot": 2.0})
    asked = Counter()

    class Asked(dict):
        def get(self, key, default=None):
            asked[key] += 1
            return super().get(key, default)

    own.weights = Asked(own.weights)
    for _ in range(3):
        assert len(set(own.scores(["an idiot insulting", "insulting an idiot"]))) == 1
    assert max(asked.values()) == 1
