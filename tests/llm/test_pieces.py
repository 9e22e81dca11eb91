"""Word probabilities against the sum over every segmentation, one by one."""

import math
from functools import cache

import numpy as np
import pytest

from palimpsest.llm import pieces

VOCABULARY = [pieces.MARK, pieces.MARK + "a", "a", "b", "ab", "ba", "aba", pieces.MARK + "ab", "bb", "c"]


@pytest.fixture(scope="module")
def model():
    lattice = pieces.Lattice(VOCABULARY)
    rng = np.random.default_rng(2)
    chances = rng.uniform(0.1, 1, (lattice.size, 2))
    return pieces.Model(["x", "y"], lattice, chances / chances.sum(axis=0))


def chance(model, word, language):
    """Sum over all segmentations; a character that is no piece is the last piece."""
    text = pieces.MARK + word

    def piece(part):
        if part in VOCABULARY:
            return model.chances[VOCABULARY.index(part), language]
        return model.chances[-1, language] if len(part) == 1 else 0.0

    @cache
    def upto(end):
        return 1.0 if end == 0 else sum(upto(k) * piece(text[k:end]) for k in range(max(0, end - 4), end))

    return upto(len(text))


def test_a_word_is_the_sum_over_its_segmentations(model):
    words = ["a", "ab", "abab", "bba", "c", "zab", "abcabz", "ababababab"]
    found = pieces.log_chances(words, model.lattice, model.chances)
    for word, row in zip(words, found):
        assert np.allclose(row, [math.log(chance(model, word, k)) for k in range(2)], rtol=1e-9)


def test_prediction_is_the_product_over_words(model):
    text = "Ab, zab! 12 abab\tab"
    total = [sum(math.log(chance(model, w, k)) for w in ("ab", "zab", "abab", "ab")) for k in range(2)]
    lang, score = model.predict(text)
    assert lang == model.languages[int(np.argmax(total))]
    assert math.isclose(score, 1 / sum(math.exp(t - max(total)) for t in total), rel_tol=1e-9)
    assert model.predict("12 !") == ("und", 0.0) and model.predict(None) == ("und", 0.0) and model.predict("") == ("und", 0.0)


def test_a_round_of_learning_raises_the_likelihood(model):
    words, weights = ["abab", "bba", "ab", "zab"], np.array([[3.0, 0], [1, 2], [5, 1], [0, 4]])
    before = (pieces.log_chances(words, model.lattice, model.chances) * weights).sum(axis=0)
    counts = pieces.expected_counts(words, weights, model.lattice, model.chances)
    after = (pieces.log_chances(words, model.lattice, (counts + 1e-12) / (counts + 1e-12).sum(axis=0)) * weights).sum(axis=0)
    assert (after >= before - 1e-9).all() and after.sum() > before.sum()


def test_a_very_long_word(model):
    lang, score = model.predict("ab" * 400 + " " + "c" * 300)
    assert lang in model.languages and 0 <= score <= 1
