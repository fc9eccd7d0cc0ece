"""Words of a history beyond the broadcast vocabulary of the language model."""

import random

import numpy as np
import pytest
from brute import odd_documents

from sheetlens.llm import maxent


@pytest.mark.parametrize("known", [1 << 20, 30])
def test_words_beyond_the_vocabulary_foretell_what_follows(spark, monkeypatch, known):
    # all words are of one class; 200 words that are no head words foretell which of 20 frequent words follows
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{p}zz h{p % 20}zz" for p in (rng.randrange(200) for _ in range(40)))) for i in range(600)]
    monkeypatch.setattr(maxent, "KNOWN", known)
    scores = {}
    for words in (0, 40):  # of 220 frequent words
        monkeypatch.setattr(maxent, "WORDS", words)
        held = maxent.score_documents(odd_documents(spark, texts)).where("held_out").collect()
        assert len(held) == len({r["doc_id"] for r in held}) > 30
        scores[words] = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert scores[40] > scores[0] + 0.1


def test_branches_multiply_to_the_softmax():
    rng = np.random.default_rng(2)
    e = np.exp(rng.standard_normal((9, maxent.SLOTS))).astype(np.float32)
    for target in range(maxent.SLOTS):
        odds = maxent.branch_odds(e, np.full(9, target)).astype(float)
        assert np.allclose((1 / (1 + np.exp(-odds))).prod(axis=1), e[:, target] / e.sum(axis=1), rtol=5e-3)


def test_weights_of_a_node_are_its_training_shares():
    # 3,000 tokens after each of two words, one in three to the right and nine in ten; the model gives even odds
    node, right = np.repeat([0, 1], 3000), np.concatenate([np.arange(3000) % 3 == 0, np.arange(3000) % 10 > 0])
    training = (np.arange(6000) % 7 > 0).astype(np.float32)
    gain = maxent._gained(node, right, np.zeros(6000, np.float32), training)
    for word, share in ((0, 1 / 3), (1, 0.9)):
        own = node == word
        assert np.allclose(gain[own & right], np.log(2 * share), atol=0.01)
        assert np.allclose(gain[own & ~right], np.log(2 * (1 - share)), atol=0.06)
