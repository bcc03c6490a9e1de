"""Linear-chain CRF sums in numpy, for batches of padded sequences (time first)."""

from __future__ import annotations

import numpy as np


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, live: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (T, B, K), expected transition counts (K, K) and log partition (B).

    emit: (T, B, K); trans[i, j]: from i to j; start: (K); live: (T, B), False behind a sequence's end.
    ``weight`` (B) weighs the sequences in the transition counts, which are left out (zeros) without it.
    """
    t_max, n, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = start + emit[0]
    for t in range(1, t_max):
        new = logsumexp(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
        alpha[t] = np.where(live[t][:, None], new, alpha[t - 1])
    for t in range(t_max - 2, -1, -1):
        new = logsumexp(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(live[t + 1][:, None], new, 0)
    log_z = logsumexp(alpha[-1], 1)
    marginal = np.exp(alpha + beta - log_z[:, None]) * live[:, :, None]
    pairs = np.zeros((k, k))
    for t in range(1, t_max if weight is not None else 0):
        joint = np.exp(alpha[t - 1][:, :, None] + trans + (emit[t] + beta[t])[:, None, :] - log_z[:, None, None])
        pairs += (joint * (live[t] * weight)[:, None, None]).sum(axis=0)
    return marginal, pairs, log_z


def best_path(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The most likely labels (T, B)."""
    t_max, n, k = emit.shape
    back = np.empty((t_max, n, k), np.int8)
    score = start + emit[0]
    for t in range(1, t_max):
        step = score[:, :, None] + trans
        back[t] = step.argmax(axis=1)
        score = step.max(axis=1) + emit[t]
    path = np.empty((t_max, n), np.int8)
    path[-1] = score.argmax(axis=1)
    for t in range(t_max - 1, 0, -1):
        path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(np.int64), 1)[:, 0]
    return path


class Adam:
    """Adam steps over a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.steps = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.steps), self.v[k] / (1 - 0.999**self.steps)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)
