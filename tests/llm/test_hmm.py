"""The language model against plain recursions."""

import math

import numpy as np
import pytest

from palimpsest.llm import hmm

K, CLASSES = 3, 7


@pytest.fixture()
def chain():
    rng = np.random.default_rng(4)
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Chain(share(rng.uniform(0.1, 1, K)), share(rng.uniform(0.1, 1, (K, K))), share(rng.uniform(0.1, 1, (K, CLASSES))).T)


def texts(longest):
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, longest, longest // 2, 5, 8, 16, 17, longest - 1]
    return [rng.integers(0, CLASSES, n).astype("<u4") for n in sizes]


def forward(chain, x):
    """Plain forward recursion in log space."""
    alpha = np.log(chain.start) + np.log(chain.emit[x[0]])
    for o in x[1:]:
        alpha = np.array([np.logaddexp.reduce(alpha + np.log(chain.move[:, j])) for j in range(K)]) + np.log(chain.emit[o])
    return np.logaddexp.reduce(alpha)


def counts(chain, x):
    """Expected starts, moves and emissions from whole forward and backward tables in log space."""
    n = len(x)
    alpha, beta = np.zeros((n, K)), np.zeros((n, K))
    alpha[0] = np.log(chain.start) + np.log(chain.emit[x[0]])
    for t in range(1, n):
        alpha[t] = [np.logaddexp.reduce(alpha[t - 1] + np.log(chain.move[:, j])) for j in range(K)] + np.log(chain.emit[x[t]])
    for t in range(n - 2, -1, -1):
        beta[t] = [np.logaddexp.reduce(np.log(chain.move[i]) + np.log(chain.emit[x[t + 1]]) + beta[t + 1]) for i in range(K)]
    whole = np.logaddexp.reduce(alpha[-1])
    gamma = np.exp(alpha + beta - whole)
    moves, emitted = np.zeros((K, K)), np.zeros((CLASSES, K))
    for t in range(n):
        emitted[x[t]] += gamma[t]
        if t:
            moves += np.exp(alpha[t - 1][:, None] + np.log(chain.move) + (np.log(chain.emit[x[t]]) + beta[t])[None] - whole)
    return gamma[0], moves, emitted


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_score_is_the_plain_forward_recursion(chain, block, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", block)
    given = texts(70)
    assert np.allclose(chain.log_likelihoods(given), [forward(chain, x) for x in given], rtol=1e-12)


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_counts_are_plain_baum_welch(chain, block, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", block)
    given = texts(70)
    plain = [sum(parts) for parts in zip(*(counts(chain, x) for x in given))]
    for found, own in zip(chain.expected(given), plain):
        assert np.allclose(found, own, rtol=1e-9)


def test_a_round_raises_the_likelihood(chain):
    given = texts(300)
    before = chain.log_likelihoods(given).sum()
    flat = np.concatenate([x.ravel() for x in chain.expected(given)])
    after = hmm.Chain.estimated(flat, np.full(CLASSES, 1e-9), K)
    assert after.log_likelihoods(given).sum() > before


def test_whole_scores_on_a_small_table(spark):
    """Score = classes by plain recursion + shares within classes, with the trained model learnt anew here."""
    rows = [(i, " ".join(["the", "a", f"w{i % 5}", "of", f"x{i}"] * (1 + i % 4)), "k") for i in range(40)]
    rows += [(100, None, "k"), (101, "", "k"), (102, "the of the " * 3000, "k"), (103, "new words only", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, symbols string")
    found = {r["doc_id"]: r for r in hmm.score_texts(df).collect()}
    assert len(found) == len(rows) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in found.values())
    assert found[100]["score"] == found[101]["score"] and found[100]["n_tokens"] == 1
    assert found[102]["n_tokens"] == 9001
    # a text of known words in training order is likelier than the same number of unknown ones
    assert found[103]["score"] < found[0]["score"] or found[0]["n_tokens"] > found[103]["n_tokens"]
    total = found[0]["train_tokens"]
    assert total == sum(r["n_tokens"] for r in found.values() if not r["held_out"])


def test_share_below_the_lookup_is_refused(spark):
    with pytest.raises(ValueError):
        hmm.score_texts(spark.createDataFrame([], "doc_id bigint, text string"), share=1e-9)
