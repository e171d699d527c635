"""Scores do not depend on when the tagger forgets its words."""

import numpy as np

from codexa.llm import toxicity

MODEL = {"weights": {"> vile": 3.0, "< vile": 2.0}, "bias": -2.0, "trans": np.array([[0.9, 0.1], [0.3, 0.7]]), "start": np.array([0.9, 0.1])}


def test_scores_after_a_clear_are_those_without_one(monkeypatch):
    feature = next(iter(toxicity.token_features("vile")))
    model = MODEL | {"weights": MODEL["weights"] | {feature: 6.0}}
    calls = [["one two three"], ["vile four"], ["five six seven"], ["eight vile nine ten"], ["one two three"], ["vile"], ["eleven twelve"]]

    def scores():
        tagger = toxicity.Tagger(model)
        return [p for texts in calls for p in tagger(texts)]

    whole = scores()
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 2)
    assert all(np.array_equal(a, b) for a, b in zip(whole, scores(), strict=True))
