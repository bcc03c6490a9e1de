"""The CRF's sums and best path against enumeration of all label sequences, gradients against differences."""

from itertools import product

import numpy as np
from footfall.llm.crf import best_path, forward_backward


def model(seed, t_max=5, n=4, k=3):
    rng = np.random.default_rng(seed)
    emit, trans, start = rng.normal(size=(t_max, n, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    length = rng.integers(1, t_max + 1, n)
    length[0] = t_max
    return emit, trans, start, length, np.arange(t_max)[:, None] < length


def paths(emit, trans, start, length, b):
    """All label sequences of sequence ``b`` with their scores."""
    for y in product(range(emit.shape[2]), repeat=length[b]):
        score = start[y[0]] + sum(emit[t, b, x] for t, x in enumerate(y)) + sum(trans[i, j] for i, j in zip(y, y[1:]))
        yield y, score


def test_marginals_equal_enumeration():
    for seed in range(10):
        emit, trans, start, length, live = model(seed)
        weight = np.arange(1.0, 5.0)
        marginal, pairs, log_z = forward_backward(emit, trans, start, live, weight)
        want, want_pairs = np.zeros_like(emit), np.zeros_like(trans)
        for b in range(4):
            ys, scores = zip(*paths(emit, trans, start, length, b))
            z = np.logaddexp.reduce(scores)
            assert abs(z - log_z[b]) < 1e-9
            for y, p in zip(ys, np.exp(np.array(scores) - z)):
                for t, x in enumerate(y):
                    want[t, b, x] += p
                for i, j in zip(y, y[1:]):
                    want_pairs[i, j] += p * weight[b]
        assert np.allclose(marginal, want, atol=1e-9) and np.allclose(pairs, want_pairs, atol=1e-9)


def test_best_path_equals_enumeration():
    for seed in range(20):
        emit, trans, start, _, _ = model(seed)
        got = best_path(emit, trans, start)
        for b in range(4):
            y, _ = max(paths(emit, trans, start, [5] * 4, b), key=lambda p: p[1])
            assert got[:, b].tolist() == list(y)


def test_expected_counts_are_the_gradient():
    emit, trans, start, _, live = model(3)
    marginal, pairs, _ = forward_backward(emit, trans, start, live, np.ones(4))

    def total(e, tr, st):
        return forward_backward(e, tr, st, live)[2].sum()

    step = 1e-5
    for place in product(range(3), repeat=2):
        d = np.zeros_like(trans)
        d[place] = step
        assert abs((total(emit, trans + d, start) - total(emit, trans - d, start)) / (2 * step) - pairs[place]) < 1e-6
    for place in product(range(5), range(4), range(3)):
        d = np.zeros_like(emit)
        d[place] = step
        assert abs((total(emit + d, trans, start) - total(emit - d, trans, start)) / (2 * step) - marginal[place]) < 1e-6
    for x in range(3):
        d = np.zeros(3)
        d[x] = step
        assert abs((total(emit, trans, start + d) - total(emit, trans, start - d)) / (2 * step) - marginal[0, :, x].sum()) < 1e-6
